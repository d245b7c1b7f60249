"""Quality by ordinal regression with cumulative links: P(grade <= k) = logistic(threshold_k - s).

s is the mean over a text's tokens of weights of hashed features of each token, shared by all grades; the thresholds are
ordered. Expected grades and tail probabilities P(grade >= k) rank and select documents. The fit takes a bounded
sample of graded documents; every whole text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import store
from meshframe.llm.sampling import labelled_sample

EACH, MOST_BYTES = 2000, 50_000
BITS = 18
THRESHOLD = 0.5
CACHE = 400_000
_RUNS = [(re.compile(p), r) for p, r in ((r"[^\W\d_a-zß-öø-ÿ]+", "A"), (r"[^\W\d_A]+", "a"), (r"\d+", "9"), (r"([^\w\s])\1+", r"\1\1"))]


def features(token: str) -> list[int]:
    """Hashes of a token's lower-case form, its shape, and what is not a letter at its end."""
    shape = token
    for pattern, to in _RUNS:
        shape = pattern.sub(to, shape)
    tail = token[len(token.rstrip("!?.,;:|%$#&*-_=+~/<>()[]{}\"'")) :]
    return [crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in (token.lower(), f"{shape}\t", f"{tail}\n")]


#: The feature of a token that is the same as the one before it.
_AGAIN = crc32(b"\r") >> (32 - BITS)


def _again(tokens: list[str]) -> int:
    return sum(map(eq, tokens, tokens[1:]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "grade"))
        out: dict = {"grade": [], "bags": [], "tokens": []}
        for text, grade in zip(*columns, strict=True):
            out["grade"].append(grade)
            tokens = (text or "").split()
            out["bags"].append(np.array([f for t in tokens for f in features(t)] + [_AGAIN] * _again(tokens), np.int32).tobytes())
            out["tokens"].append(len(tokens))
        yield pa.record_batch({"grade": pa.array(out["grade"], pa.int32()), "weight": batch.column(batch.schema.get_field_index("weight")), "bags": pa.array(out["bags"], pa.binary()), "tokens": pa.array(out["tokens"], pa.int64())})


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative(bags: list[np.ndarray], tokens: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int, *, steps: int = 150, rate: float = 0.5, shrink: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Ordered thresholds (grades - 1 of them) and weights, by proximal AdaGrad; features of one document stay 0."""
    theta = np.zeros(1 << BITS)
    start = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1)
    if not len(y):
        return start, theta
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(b) for b in bags])
    feature = np.concatenate(bags).astype(np.int64)
    pair, count = np.unique(doc.astype(np.int64) << BITS | feature, return_counts=True)
    doc, feature = (pair >> BITS).astype(np.int32), pair & ((1 << BITS) - 1)
    keep = (np.bincount(feature, minlength=1 << BITS) >= 2)[feature]
    doc, count = doc[keep], count[keep]
    used, feature = np.unique(feature[keep], return_inverse=True)
    x = count / np.maximum(1, tokens)[doc]
    w, gw = np.zeros(len(used)), np.full(len(used), 1e-10)
    first, gaps = start[0], np.log(np.diff(start)) if grades > 2 else np.zeros(0)
    gt = np.full(grades - 1, 1e-8)
    weight = weight / weight.sum()
    for _ in range(steps):
        t = np.concatenate(([first], first + np.cumsum(np.exp(gaps))))
        s = np.bincount(doc, w[feature] * x, len(y))
        upper = np.where(y < grades - 1, _logistic(t[np.minimum(y, grades - 2)] - s), 1.0)
        lower = np.where(y > 0, _logistic(t[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        g = weight * (upper + lower - 1)
        step = np.bincount(feature, g[doc] * x, len(used))
        dt = np.bincount(np.minimum(y, grades - 2), weight * upper * (1 - upper) / p, grades - 1) - np.bincount(np.maximum(y - 1, 0), weight * lower * (1 - lower) / p, grades - 1)
        gw += step * step
        scale = rate / np.sqrt(gw)
        w = w + scale * step
        w = np.sign(w) * np.maximum(np.abs(w) - scale * shrink, 0)
        own = np.concatenate(([dt.sum()], [dt[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))]))
        gt += own * own
        move = 0.2 / np.sqrt(gt) * own
        first, gaps = first + move[0], np.clip(gaps + move[1:], -4, 4)
    theta[used] = w
    return np.concatenate(([first], first + np.cumsum(np.exp(gaps)))), theta


class _Weights(dict):
    """Weights of tokens, filled on demand and bounded."""

    def __init__(self, theta: np.ndarray):
        super().__init__()
        self.theta = theta

    def __missing__(self, token: str) -> float:
        value = float(sum(self.theta[f] for f in features(token)))
        if len(self) >= CACHE:
            self.clear()
        if len(token) < 64:
            self[token] = value
        return value


def _scored(batches: Iterator[pa.RecordBatch], model, names: list[str]) -> Iterator[pa.RecordBatch]:
    thresholds, used, weights = model.value
    theta = np.zeros(1 << BITS)
    theta[used] = weights
    known = _Weights(theta).__getitem__
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            s = []
            for t in part.column(part.schema.get_field_index("text")):
                tokens = (t.as_py() or "").split()
                s.append((sum(map(known, tokens)) + theta[_AGAIN] * _again(tokens)) / max(1, len(tokens)))
            tails = 1 - _logistic(thresholds[None, :] - np.array(s)[:, None])
            yield pa.RecordBatch.from_pydict({**{c: part.column(part.schema.get_field_index(c)) for c in names}, "expected_grade": pa.array(tails.sum(1)), "tails": pa.array(tails.tolist(), pa.list_(pa.float64()))})


def fit(docs: DataFrame, grades: DataFrame, *, levels: int = 3, each: int = EACH, most_bytes: int = MOST_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and weights from a sample of at most `each` documents a grade; grades has doc_id and grade."""
    known = grades.select("doc_id", F.col("grade").cast("int").alias("grade")).filter((F.col("grade") >= 0) & (F.col("grade") < levels))
    sample = labelled_sample(docs.select("doc_id", "text"), known, each=each, most_bytes=most_bytes)
    got = sample.mapInArrow(_featured, "grade int, weight double, bags binary, tokens long").toArrow()
    bags = [np.frombuffer(x, np.int32) for x in got.column("bags").to_pylist()]
    return fit_cumulative(bags, np.array(got.column("tokens").to_pylist(), int), np.array(got.column("grade").to_pylist(), int), np.array(got.column("weight").to_pylist(), float), levels)


def score(docs: DataFrame, grades: DataFrame, *, levels: int = 3, each: int = EACH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns of docs (doc_id, text), then expected_grade and tails, P(grade >= 1), P(grade >= 2) and so on.

    grades has doc_id and grade, 0 to levels - 1; others and nulls are left out, and held-out ids too. Null, empty and
    blank texts have s = 0. Without grades nothing is learnt and all texts score alike. Repeated rows score alike.
    Columns of docs that clash with the new ones are replaced.
    """
    docs = store.without(docs, "expected_grade", "tails")
    names, docs = docs.columns, store.plain(docs)
    thresholds, theta = fit(docs, grades, levels=levels, each=each, most_bytes=most_bytes)
    used = np.flatnonzero(theta)
    model = docs.sparkSession.sparkContext.broadcast((thresholds, used, theta[used]))
    return store.named(docs.mapInArrow(partial(_scored, model=model, names=docs.columns), store.extended(docs, "expected_grade double, tails array<double>")), names)
