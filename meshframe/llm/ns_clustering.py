"""Centroid clustering whose bounds are loosened by the norm of the total displacement since they were taken (ns-bounds).

Every vector keeps, for each centroid, the last distance taken and the round in which it was taken. The centroids of all rounds are kept,
a few numbers: so a distance of round s bounds that of round t by the norm of the sum of the moves between them, which is at most, and mostly less than,
the sum of their norms. Where the loosened bounds can't rule out every other centroid, the vector's own distance and those that aren't ruled out
are taken anew, exactly, in integers. The bounds have a margin for rounding, so that ties are always taken anew.

A round is one pass over a stored table that is replaced by the next; the sums of the clusters change only by the vectors that moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.llm import store
from meshframe.llm.vectors import finite, fixed_point

#: Margin of the bounds, relative: far above the rounding of square roots and sums of doubles.
MARGIN = 1e-9
STATE = "__squared array<long>, __taken array<short>, __before int, cluster int"


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(-1)


def advance(x: np.ndarray, own: np.ndarray, squared: np.ndarray, taken: np.ndarray, history: np.ndarray, exact: bool) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector in the last round of history, and how many distances were taken.

    history is (rounds, centroids, components). squared and taken, the distances of each centroid and their rounds (-1: none), are updated in place.
    own is the nearest centroid before, or -1. With exact, the distance of the nearest one is of the last round in any case.
    """
    t, k = len(history) - 1, history.shape[1]
    every = np.arange(len(x))
    count = 0
    fresh = own < 0
    if fresh.any():
        rows = np.flatnonzero(fresh)
        for lo in range(0, len(rows), 1024):
            some = rows[lo : lo + 1024]
            squared[some] = _squares(x[some, None, :], history[t][None])
        taken[rows] = t
        count += rows.size * k
        own = np.where(fresh, squared.argmin(1), own)
    shift = np.sqrt(((history[t] - history) ** 2).sum(-1).astype(float))[taken, np.arange(k)]
    bound = np.sqrt(squared.astype(float))
    slack = MARGIN * (bound + shift + 1)
    lower, upper = bound - shift - slack, (bound + shift + slack)[every, own]
    lower[every, own] = np.inf
    loose = (lower.min(1, initial=np.inf) <= upper) & ~fresh
    anew = np.flatnonzero((loose | exact) & (taken[every, own] < t))
    squared[anew, own[anew]] = _squares(x[anew], history[t][own[anew]])
    taken[anew, own[anew]] = t
    count += anew.size
    rows = np.flatnonzero(loose)
    distance = squared[rows, own[rows]]
    row, other = np.nonzero(lower[rows] <= (np.sqrt(distance.astype(float)) * (1 + MARGIN) + MARGIN)[:, None])
    row = rows[row]
    stale = taken[row, other] < t
    a, b = row[stale], other[stale]
    for lo in range(0, len(a), 65_536):
        i, j = a[lo : lo + 65_536], b[lo : lo + 65_536]
        squared[i, j] = _squares(x[i], history[t][j])
    taken[a, b] = t
    count += a.size
    able = np.full((len(rows), k), np.iinfo(np.int64).max)
    able[np.searchsorted(rows, row), other] = squared[row, other]
    able[np.arange(len(rows)), own[rows]] = distance
    out = own.copy()
    out[rows] = able.argmin(1)  # the first of the least: ties to the smaller number
    return out, count


def _list(x: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel().astype(kind)))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _round(batches: Iterator[pa.RecordBatch], history, names: list[str], at: int, scale: int, last: bool) -> Iterator[pa.RecordBatch]:
    """The state after one more round; with last, the distance instead of it. The vectors are the column `at`."""
    past = history.value
    k = past.shape[1]
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            rows = batch.slice(lo, 4096)
            n = rows.num_rows
            get = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: B023, E731
            x = fixed_point(rows.column(at), scale)
            if len(past) == 1:
                own = np.full(n, -1)
                squared, taken = np.zeros((n, k), np.int64), np.full((n, k), -1)
            else:
                own = get("cluster").to_numpy().astype(int)
                squared, taken = _matrix(get("__squared"), n).copy(), _matrix(get("__taken"), n).astype(int)
            new, _ = advance(x, own, squared, taken, past, last)
            out = {c: get(c) for c in names}
            if last:
                out |= {"cluster": pa.array(new.astype(np.int32)), "distance": pa.array(squared[np.arange(n), new])}
            else:
                out |= {"__squared": _list(squared, np.int64), "__taken": _list(taken, np.int16), "__before": pa.array(own.astype(np.int32)), "cluster": pa.array(new.astype(np.int32))}
            yield pa.RecordBatch.from_pydict(out)


def _changes(batches: Iterator[pa.RecordBatch], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """By how much the vectors of this task that moved change the count and sums of each cluster."""
    sums, counts = None, np.zeros(k, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = fixed_point(batch.column(0), scale)
        sums = np.zeros((k, x.shape[1]), np.int64) if sums is None else sums
        for number, sign in ((batch.column(1).to_numpy(), -1), (batch.column(2).to_numpy(), 1)):
            for j in np.unique(number[number >= 0]):
                sums[j] += sign * x[number == j].sum(0)
                counts[j] += sign * np.count_nonzero(number == j)
    if sums is not None:
        yield pa.record_batch({"cluster": pa.array(np.arange(k, dtype=np.int32)), "count": pa.array(counts), "sums": _list(sums, np.int64)})


def starts(rows: DataFrame, column: str, centroids: int, seed: int) -> DataFrame:
    """The vectors of the rows with the least SHA-256 of `<seed>:<vec_id>`, in its order; rows of one vec_id by their vectors. Rows without vec_id are none."""
    named = rows.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"), store.column(column).alias("vector"))
    return named.orderBy("hash", "vector").limit(centroids)


def cluster(vectors: DataFrame, *, column: str = "embedding", components: int = 64, centroids: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """The rows of vectors (with vec_id) with their cluster and squared distance, and the centroids, an int64 matrix.

    Vectors are integers floor(scale * x). Rows whose vector is null, holds null or non-finite components or hasn't just this number of them are left out. Each round
    assigns every vector to its nearest centroid, ties to the smaller number, and replaces each centroid that has vectors by floor(sum / count);
    others stay. Then vectors are assigned once more. Rounds that would change nothing are not run. With fewer rows that have a vec_id there
    are fewer centroids; with none, the result is empty. Repeated rows count as often as they come. Columns that clash with the new ones are replaced.
    """
    rows = store.without(vectors.filter(finite(column) & (F.size(store.column(column)) == components)), "cluster", "distance")
    names, at = rows.columns, rows.columns.index(column)
    first = starts(rows, column, centroids, seed).toArrow()
    if not first.num_rows:
        return rows.limit(0).withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")}), np.empty((0, components), np.int64)
    order = np.argsort(np.array(first.column(0).to_pylist()), kind="stable")
    history = fixed_point(first.column(1).combine_chunks(), scale)[order][None]
    k = history.shape[1]
    state = plain = store.plain(rows)
    context = rows.sparkSession.sparkContext
    sums, counts = np.zeros((k, components), object), np.zeros(k, object)
    step = lambda last: partial(_round, history=context.broadcast(history), names=plain.columns, at=at, scale=scale, last=last)
    old = None
    for _ in range(rounds):
        state, before = store.stored(state.mapInArrow(step(False), store.extended(plain, STATE)), "clusters"), state
        if old is not None:
            store.drop(before)
        old = state
        moved = state.filter("cluster != __before").select(plain.columns[at], "__before", "cluster").mapInArrow(partial(_changes, k=k, scale=scale), "cluster int, count long, sums array<long>")
        found = moved.groupBy("cluster").agg(F.sum("count").alias("count"), F.array(*(F.sum(F.col("sums")[i]) for i in range(components))).alias("sums")).collect()
        for r in found:  # one row a centroid
            counts[r["cluster"]] += r["count"]
            sums[r["cluster"]] += np.array(r["sums"], object)
        after = history[-1].copy()
        for j in np.flatnonzero(counts > 0):
            after[j] = sums[j] // counts[j]
        history = np.concatenate((history, after[None]))
        if not found:
            break
    out = state.mapInArrow(step(True), store.extended(plain, "cluster int, distance long"))
    return store.named(out, names), history[-1]


def picked(values: list, number: Column | str) -> Column:
    """The value of the cluster with this number, from a value for each."""
    return F.array(*map(F.lit, values))[F.col(number) if isinstance(number, str) else number] if values else F.lit(None)


def digests(c: np.ndarray) -> list[str]:
    """SHA-256 of each centroid's components in decimal, joined by commas."""
    return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
