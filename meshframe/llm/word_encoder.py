"""Ids of texts by a tokenizer file of the tokenizers library, with ids of words kept in each worker.

Where the file's own steps put a boundary at every blank, a text is encoded blank by blank, and a word that comes again costs
one look-up. Words of plain letters go to the library's model part by part; all others go through the whole library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np

#: Words that are not plain, and parts of plain ones, that a worker keeps.
WORDS, PARTS = 100_000, 1_000_000
#: The steps of a tokenizer file, for which blanks are boundaries and the parts of a plain word follow PLAIN_PARTS (fixed values).
APART_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
APART_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Plain texts: visible ASCII and the composed letters of Latin-1, which lower case and NFC change one by one, between blanks.
PLAIN = re.compile("[ \\n!-~À-ÖØ-öø-ÿ]*")
PLAIN_PARTS = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \\na-z0-9ß-öø-ÿ]+")
LETTERS = "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100))))


class Words(dict):
    """Bytes of the ids of each word, made when it is first asked for."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Encoder:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False) does, to little-endian ids of `kind`."""

    def __init__(self, spec: str, kind: str, special_as_text: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.kind = Tokenizer.from_str(spec), np.dtype(kind)
        self.whole.encode_special_tokens = special_as_text
        known = json.loads(spec)
        split = (known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = [t["content"] for t in known.get("added_tokens") or []]
        self.apart = known.get("normalizer") == APART_NORMALIZER and split[0] == {"type": "Split", "pattern": {"Regex": APART_PATTERN}, "behavior": "Removed", "invert": True}
        self.apart &= known.get("post_processor") is None and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in known.get("added_tokens") or []) and not any(re.search(r"\s", t) for t in added)
        self.apart &= len(split) == 2 and split[1].get("type") == "ByteLevel" and not split[1].get("use_regex") and not split[1].get("add_prefix_space")
        if self.apart:
            self.added = added
            self.letters = {ord(c): self.whole.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS}
            self.parts = Words(self._part, PARTS)
            self.words = Words(self._word, WORDS)

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.translate(self.letters)
        return np.array([t.id for t in self.whole.model.tokenize(mapped)], self.kind).tobytes()

    def _plain(self, text: str) -> bytes | None:
        if PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return b"".join(map(self.parts.__getitem__, PLAIN_PARTS.findall(text.lower())))
        return None

    def _word(self, word: str) -> bytes:
        found = self._plain(word)
        return self._ids(word) if found is None else found

    def ids(self, text: str) -> bytes:
        if not self.apart:
            return self._ids(text)
        found = self._plain(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) if found is None else found


_encoders: dict[str, Encoder] = {}


def encoder(spec: str, kind: str, special_as_text: bool) -> Encoder:
    key = f"{hashlib.md5(spec.encode()).hexdigest()} {kind} {special_as_text}"
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec, kind, special_as_text)
    return _encoders[key]
