"""Vector codes by codebooks of each part, with the equal-average search for the nearest entry.

For vectors x and y of d components, (sum(x) - sum(y))**2 <= d * |x - y|**2. So entries are sorted by the sum of their components,
and the search goes outward from the sum of the part that is coded, up and down, until the squared gap of the sums, over d, strictly
exceeds the least distance found: what lies beyond can't be nearer, nor as near. Parts are searched together in groups of like sums.

All figures are integers of fixed point, so sums over any number of tasks are exact. Codebooks are a few numbers: a round sends
each task's sums of each entry, never the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import store
from meshframe.llm.vectors import finite, fixed_point

#: Parts of like sums that are searched together, and entries that a step outward takes on each side.
GROUP, STEP = 256, 16


class Book:
    """The entries of one part position, in the order of their sums."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(1)
        self.index = np.argsort(sums, kind="stable")
        self.sums, self.sorted = sums[self.index], entries[self.index]
        self.norms = (self.sorted**2).sum(1)


def search(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry to each row of x, ties to the lower index; how many distances were taken."""
    n, d = x.shape
    k = len(book.sums)
    sums, norms = x.sum(1), (x * x).sum(1)
    best, found = np.full(n, np.iinfo(np.int64).max // max(1, d)), np.full(n, k)
    # Products of doubles are exact, and much faster, where they stay below 2**53.
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book.sorted).max(initial=0)))
    kind = np.float64 if 4 * d * most * most < 1 << 53 else np.int64
    own, entries = x.astype(kind), book.sorted.astype(kind)
    taken = 0
    order = np.argsort(sums, kind="stable")
    for at in range(0, n, GROUP):
        rows = order[at : at + GROUP]
        up = down = int(np.searchsorted(book.sums, sums[rows[len(rows) // 2]]))
        while True:
            # The parts of the group that an entry beyond `up` or `down` may still serve.
            above = rows[np.maximum(book.sums[up] - sums[rows], 0) ** 2 <= d * best[rows]] if up < k else rows[:0]
            below = rows[np.maximum(sums[rows] - book.sums[down - 1], 0) ** 2 <= d * best[rows]] if down else rows[:0]
            if not len(above) and not len(below):
                break
            for some, lo, hi in ((above, up, min(k, up + STEP)), (below, max(0, down - STEP), down)):
                if not len(some):
                    continue
                dist = norms[some, None] + book.norms[lo:hi] - 2 * (own[some] @ entries[lo:hi].T).astype(np.int64)
                taken += dist.size
                least = dist.min(1)
                index = np.where(dist == least[:, None], book.index[lo:hi], k).min(1)
                better = (least < best[some]) | ((least == best[some]) & (index < found[some]))
                best[some[better]], found[some[better]] = least[better], index[better]
            up, down = min(k, up + STEP) if len(above) else up, max(0, down - STEP) if len(below) else down
    return found, best, taken


def _cuts(length: int, parts: int) -> np.ndarray:
    """Bounds of the parts; where the length can't be divided, the first ones are one longer."""
    return np.concatenate(([0], np.cumsum([length // parts + (i < length % parts) for i in range(parts)])))


def _coded(x: np.ndarray, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    cuts = _cuts(x.shape[1], len(books))
    found = [search(x[:, a:b], book)[:2] for a, b, book in zip(cuts, cuts[1:], books, strict=False)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(batches: Iterator[pa.RecordBatch], books, scale: int) -> Iterator[pa.RecordBatch]:
    """Count and component sums of the parts that each entry has in this task."""
    made = [Book(e) for e in books.value]
    sums, counts = [np.zeros_like(b.entries) for b in made], [np.zeros(len(b.entries), np.int64) for b in made]
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            x = fixed_point(batch.column(0).slice(lo, 4096), scale)
            cuts = _cuts(x.shape[1], len(made))
            codes, _ = _coded(x, made)
            for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                order = np.argsort(codes[:, p], kind="stable")
                entry, first, count = np.unique(codes[order, p], return_index=True, return_counts=True)
                if b > a:
                    sums[p][entry] += np.add.reduceat(x[order, a:b], first, axis=0)
                counts[p][entry] += count
    width = max((s.shape[1] for s in sums), default=0)
    for p, (s, c) in enumerate(zip(sums, counts, strict=True)):
        used = np.flatnonzero(c)
        padded = np.zeros((len(used), width), np.int64)
        padded[:, : s.shape[1]] = s[used]
        yield pa.record_batch({"part": pa.array(np.full(len(used), p, np.int32)), "entry": pa.array(used.astype(np.int32)), "count": pa.array(c[used]), "sums": pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), width).cast(pa.list_(pa.int64())) if width else pa.array([[]] * len(used), pa.list_(pa.int64()))})


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is finite and as long as most (of lengths that are equally frequent, the shorter)."""
    rows = vectors.filter(finite(column))
    size = F.size(store.column(column))
    length = rows.groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(size == (length[0] if length else 0))


def train(vectors: DataFrame, *, column: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> list[np.ndarray]:
    """The codebooks, an int64 matrix for each part position, from vectors (vec_id and column).

    They start as the parts of the rows of the smallest vec_ids (rows that share one by their vectors, rows without one last), at most
    `entries` of them. Each round assigns every part to its nearest entry, ties to the lower index, and replaces each entry that has
    parts by floor(sum / count); others stay. Which rows take part: see kept. Without any, the codebooks are empty.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    rows = kept(vectors, column)
    first = rows.select("vec_id", store.column(column).alias("vector")).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()
    x = fixed_point(first.column(0).combine_chunks(), scale) if first.num_rows else np.empty((0, parts), np.int64)
    cuts = _cuts(x.shape[1], parts)
    books = [x[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)]
    width = max(b.shape[1] for b in books)
    for _ in range(rounds if len(x) else 0):
        sent = rows.sparkSession.sparkContext.broadcast(books)
        partly = rows.select(store.column(column)).mapInArrow(partial(_sums, books=sent, scale=scale), "part int, entry int, count long, sums array<long>")
        found = partly.groupBy("part", "entry").agg(F.sum("count").alias("count"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()
        books = [b.copy() for b in books]
        for r in found:  # at most parts * entries rows
            d = books[r["part"]].shape[1]
            books[r["part"]][r["entry"]] = np.array(r["sums"][:d], np.int64) // r["count"]
    return books


def _encoded(batches: Iterator[pa.RecordBatch], books, scale: int, at: int) -> Iterator[pa.RecordBatch]:
    made = [Book(e) for e in books.value]
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            rows = batch.slice(lo, 4096)
            codes, errors = _coded(fixed_point(rows.column(at), scale), made)
            new = [pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(errors.sum(1))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*rows.schema.names, "code", "error"])


def encode(vectors: DataFrame, books: list[np.ndarray], *, column: str = "embedding", scale: int = 1024) -> DataFrame:
    """The rows of vectors that take part (see kept), with their columns, code (a byte for each part) and error, the squared distances summed over the parts.

    Columns that clash with the new ones are replaced. Rows that repeat stay; an empty table, or codebooks without entries, give an empty table.
    """
    rows = store.without(kept(vectors, column), "code", "error")
    if not len(books[0]):
        rows = rows.limit(0)
    names, at, rows = rows.columns, rows.columns.index(column), store.plain(rows)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    return store.named(rows.mapInArrow(partial(_encoded, books=sent, scale=scale, at=at), store.extended(rows, "code binary, error long")), names)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def summed(coded: DataFrame, by: str) -> DataFrame:
    """coded with <by>_error, the error summed over the rows of equal `by`, nulls together. Each task sums first; a frequent value is no large group."""
    name = f"{by}_error"
    coded = store.stored(store.without(coded, name), "codes")
    sums = store.stored(coded.groupBy(store.column(by).alias("__by")).agg(F.sum("error").alias("__sum")), "code-sums")
    found = coded.join(store.side(sums), store.column(by).eqNullSafe(F.col("__by")))
    return found.withColumnRenamed("__sum", name).drop("__by")
