"""Training-data operators: toxicity, decontamination, near duplicates, tokenizing, archives, search."""
