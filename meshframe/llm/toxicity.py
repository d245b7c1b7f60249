"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is the logistic of a sum of weights of hashed features of its words. A document is toxic if any
sentence is (noisy-or): 1 - prod(1 - p). The weights are fitted to document labels by the likelihood of that, so
that the sentences that explain the labels get the probability; they are the offending ones.

The fit takes a bounded sample of labelled documents; every whole text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import store
from meshframe.llm.sampling import labelled_sample

#: Labelled documents of each class in the fit, and the longest text of them.
EACH, MOST_BYTES = 2500, 50_000
THRESHOLD = 0.3
BITS = 20
PREFIXES = (3, 4, 5, 6, 7)
#: Words that make a sentence at most; longer ones are cut.
LONGEST = 32
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
CACHE = 400_000
#: Features of the fit that are looked at together.
PART = 1 << 20


def features(word: str) -> list[int]:
    """Hashes of the word, and of its prefixes that are shorter than it."""
    raw = [word, *(f"{word[:k]}\t" for k in PREFIXES if len(word) > k)]
    return [crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in raw]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence with words; long ones in pieces."""
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(m[0].lower())
        if len(words) <= LONGEST:
            if words:
                yield m.start(), m.end(), words
        else:
            found = list(_WORD.finditer(text, m.start(), m.end()))
            for i in range(0, len(found), LONGEST):
                own = found[i : i + LONGEST]
                yield own[0].start(), own[-1].end(), [w[0].lower() for w in own]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "grade", "weight"))
        out: dict = {"grade": [], "weight": [], "bags": [], "sizes": []}
        for text, grade, weight in zip(*columns, strict=True):
            bags = [[f for w in words for f in features(w)] for _, _, words in sentences(text or "")]
            out["grade"].append(grade)
            out["weight"].append(weight)
            out["bags"].append(np.array([f for b in bags for f in b], np.int32).tobytes())
            out["sizes"].append(np.array([len(b) for b in bags], np.int32).tobytes())
        yield pa.record_batch({"grade": pa.array(out["grade"], pa.int32()), "weight": pa.array(out["weight"], pa.float64()), "bags": pa.array(out["bags"], pa.binary()), "sizes": pa.array(out["sizes"], pa.binary())})


def fit_noisy_or(feature: np.ndarray, size: np.ndarray, sentences_of: np.ndarray, y: np.ndarray, weight: np.ndarray, *, steps: int = 120, rate: float = 0.4, shrink: float = 2e-4) -> tuple[float, np.ndarray]:
    """Bias and weights by proximal AdaGrad on the noisy-or likelihood; features that occur fewer than 3 times stay 0.

    feature has the hashes of all sentences in turn, size their number by sentence, sentences_of that of sentences by document.
    """
    theta = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        return (-20.0 if not len(y) or not y.max() else 2.0), theta
    size = size.astype(np.int64)
    doc = np.repeat(np.arange(len(y)), sentences_of)
    seen = sum(np.bincount(feature[lo : lo + PART], minlength=1 << BITS) for lo in range(0, len(feature), PART))
    keep = (seen >= 3)[feature]
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)[keep]
    feature = feature[keep]
    used = np.flatnonzero(seen >= 3)
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    feature = place[feature]
    del keep
    w, b, gw, gb = np.zeros(len(used)), -4.0, np.full(len(used), 1e-8), 1e-8
    total = weight.sum()
    parts = [slice(lo, lo + PART) for lo in range(0, len(feature), PART)]  # temporary arrays stay small
    for _ in range(steps):
        s = np.full(len(size), b)
        for i in parts:
            s += np.bincount(row[i], w[feature[i]], len(size))
        p = np.clip(1 / (1 + np.exp(-s)), 1e-9, 1 - 1e-9)
        clean = np.exp(np.bincount(doc, np.log1p(-p), len(y)))
        toxic = np.maximum(1 - clean, 1e-9)
        g = weight[doc] / total * np.where(y[doc] > 0, p * (clean / toxic)[doc], -p)
        step = np.zeros(len(used))
        for i in parts:
            step += np.bincount(feature[i], g[row[i]], len(used))
        gw += step * step
        gb += g.sum() ** 2
        scale = rate / np.sqrt(gw)
        w = w + scale * step
        w = np.sign(w) * np.maximum(np.abs(w) - scale * shrink, 0)
        b += rate / np.sqrt(gb) * g.sum()
    theta[used] = w
    return float(b), theta


class _Weights(dict):
    """Weights of words, filled on demand and bounded."""

    def __init__(self, theta: np.ndarray):
        super().__init__()
        self.theta = theta

    def __missing__(self, word: str) -> float:
        value = float(sum(self.theta[f] for f in features(word)))
        if len(self) >= CACHE:
            self.clear()
        if len(word) < 64:
            self[word] = value
        return value


_SCORED = "score double, offending array<struct<start:int,stop:int,probability:double>>"


def _scored(batches: Iterator[pa.RecordBatch], model, names: list[str], threshold: float) -> Iterator[pa.RecordBatch]:
    bias, used, weights = model.value
    theta = np.zeros(1 << BITS)
    theta[used] = weights
    known = _Weights(theta).__getitem__
    split, words_of = _SENTENCE.findall, _WORD.findall
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            score, offending = [], []
            for t in part.column(part.schema.get_field_index("text")):
                text = t.as_py() or ""
                sums = []
                for sentence in split(text.lower()):
                    words = words_of(sentence)
                    if len(words) <= LONGEST:
                        if words:
                            sums.append(sum(map(known, words)))
                    else:
                        sums.extend(sum(map(known, words[i : i + LONGEST])) for i in range(0, len(words), LONGEST))
                p = np.clip(1 / (1 + np.exp(-(bias + np.array(sums)))), 1e-12, 1 - 1e-9) if sums else np.zeros(0)
                score.append(float(-np.expm1(np.log1p(-p).sum())))
                if len(p) and p.max() >= threshold:
                    places = list(sentences(text))
                    bad = p if len(places) == len(p) else 1 / (1 + np.exp(-(bias + np.array([sum(map(known, w)) for _, _, w in places]))))
                    offending.append([{"start": places[i][0], "stop": places[i][1], "probability": float(bad[i])} for i in np.flatnonzero(bad >= threshold)])
                else:
                    offending.append([])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_pydict({**{c: part.column(part.schema.get_field_index(c)) for c in names}, "score": pa.array(score, pa.float64()), "offending": pa.array(offending, kind)})


def fit(docs: DataFrame, labels: DataFrame, *, each: int = EACH, most_bytes: int = MOST_BYTES) -> tuple[float, np.ndarray]:
    """Bias and weights from a sample of at most `each` documents a class; labels has doc_id and toxic (0, 1, null)."""
    grades = labels.select("doc_id", F.col("toxic").cast("int").alias("grade")).filter("grade in (0, 1)")
    sample = labelled_sample(docs.select("doc_id", "text"), grades, each=each, most_bytes=most_bytes)
    got = sample.mapInArrow(_featured, "grade int, weight double, bags binary, sizes binary").toArrow()
    y, weight = np.array(got.column("grade").to_pylist(), int), np.array(got.column("weight").to_pylist(), float)
    joined = lambda c: np.frombuffer(got.column(c).combine_chunks().cast(pa.large_binary()).buffers()[2] or b"", np.int32)
    sentences_of = np.array([len(x) // 4 for x in got.column("sizes").to_pylist()], int)
    feature, size = joined("bags"), joined("sizes")
    del got
    return fit_noisy_or(feature, size, sentences_of, y, weight)


def score(docs: DataFrame, labels: DataFrame, *, each: int = EACH, most_bytes: int = MOST_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs (doc_id, text), then score and offending, the sentences of at least the threshold.

    score is the noisy-or of the sentences, from 0 to 1; null, empty and wordless texts get 0. offending has
    character starts and stops. Without labels, or with one class, all scores are alike: near 0, or high if all are toxic.
    Repeated rows get the same score. Columns of docs that clash with the new ones are replaced.
    """
    docs = store.without(docs, "score", "offending")
    names, docs = docs.columns, store.plain(docs)
    bias, theta = fit(docs, labels, each=each, most_bytes=most_bytes)
    used = np.flatnonzero(theta)
    model = docs.sparkSession.sparkContext.broadcast((bias, used, theta[used]))
    return store.named(docs.mapInArrow(partial(_scored, model=model, names=docs.columns, threshold=threshold), store.extended(docs, _SCORED)), names)
