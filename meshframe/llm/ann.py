"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is split into balanced cells, whose centroids stay in memory. Every vector is indexed: in the list of its
nearest centroid, and, if it lies near a boundary, in further lists whose centroids are almost as near and in other
directions. A query searches the centroids by best-first search on a graph of their neighbours, and reads the lists whose
distance is within a ratio of the nearest one's, up to a number. Both are fixed by the table itself: the exact neighbours of some
queries tell how far their lists are, so that what is read grows with the number of lists, and with how evenly the vectors are
spread. The first few lists set a least score, which the vectors of the others must reach.

Largest inner products become least distances by one more coordinate, sqrt(longest**2 - |x|**2), which is 0 for queries.
Lists are cut into blocks of bounded size and queries of a list into runs, so that a list which holds a large
share of all rows is many tasks. Products are exact: doubles, summed in the order of the coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm import store

#: Vectors of the sample that fixes the cells, and the most cells; vectors of a list that cells aim at.
SAMPLE, MOST_LISTS, LIST = 20_000, 8192, 500
#: Lists of a vector at most, and the ratio of distances within which a boundary vector is replicated. Two centroids nearer to
#: each other than this share of the vector's distance are in one direction; in many dimensions, vectors are far from all centroids.
COPIES, NEAR, APART = 4, 1.15, 0.2
#: Least beam of the graph search (it's as wide as the lists read) and neighbours of a centroid; lists read at least.
BEAM, DEGREE = 64, 24
LEAST_READ = 32
#: Queries whose exact neighbours fix the lists read; shares of these neighbours within the ratio, and within the number too.
PROBES, WITHIN, AIM = 256, 0.98, 0.95
#: Lists that set a query's least score before the others are read.
FIRST_READ = 8
BLOCK, RUN = 4096, 512


def balanced_cells(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of balanced cells: halves of halves along the line between two means, until cells are reached."""
    rng, parts = np.random.default_rng(seed), [x]
    done: list[np.ndarray] = []
    while parts and len(parts) + len(done) < cells:
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 2 or (own == own[0]).all():
            done.append(own)
            continue
        a, b = own[rng.choice(len(own), 2, replace=False)].astype(float)
        for _ in range(8):
            side = own @ (a - b)
            left = side >= np.median(side)
            if left.all() or not left.any():
                left = side > np.median(side)
            if left.all() or not left.any():
                break
            a, b = own[left].mean(0), own[~left].mean(0)
        if left.all() or not left.any():
            spread = own[:, int(own.var(0).argmax())]
            left = spread > (spread.min() + spread.max()) / 2
        parts.extend([own[left], own[~left]])
    return np.array([p.mean(0) for p in parts + done])


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest centroids of each, the last quarter of them replaced by links across the whole."""
    n = len(c)
    degree = min(degree, n)
    out = np.empty((n, degree), np.int32)
    norm = (c * c).sum(1)
    for lo in range(0, n, 1024):
        d = norm[None, :] - 2 * c[lo : lo + 1024] @ c.T
        out[lo : lo + 1024] = np.argsort(d, 1, kind="stable")[:, :degree]
    far = degree // 4
    if far and n > degree:
        out[:, degree - far :] = np.random.default_rng(3).integers(0, n, (n, far))
    return out


def graph_search(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the centroids that best-first search finds for each query, nearest first; -1 and infinity fill short rows."""
    norm = (c * c).sum(1)
    ids_of, d_of = [], []
    entry = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int))
    for one in q:
        seen = np.zeros(len(c), bool)
        seen[entry] = True
        ids, d = entry, norm[entry] - 2 * c[entry] @ one
        opened = np.zeros(len(ids), bool)
        while True:
            order = np.argsort(d, kind="stable")[:beam]
            ids, d, opened = ids[order], d[order], opened[order]
            new = np.flatnonzero(~opened)[: max(8, beam // 8)]
            if not len(new):
                break
            opened[new] = True
            near = np.unique(graph[ids[new]])
            near = near[~seen[near]]
            seen[near] = True
            ids, d, opened = np.concatenate((ids, near)), np.concatenate((d, norm[near] - 2 * c[near] @ one)), np.concatenate((opened, np.zeros(len(near), bool)))
        ids_of.append(ids)
        d_of.append(np.maximum(d + one @ one, 0))
    width = max(map(len, ids_of))
    fill = lambda rows, empty: np.array([np.concatenate((r, np.full(width - len(r), empty, r.dtype))) for r in rows])
    return fill(ids_of, -1), fill(d_of, np.inf)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((c * c).sum(1)[None, :] + (x * x).sum(1)[:, None] - 2 * x @ c.T, 0)


def lists_of(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near lists of each vector, nearest first, and which of them hold it: the nearest one and near ones in other directions."""
    d = _distances(x, c)
    few = min(2 * COPIES, len(c))
    near = np.argpartition(d, few - 1, 1)[:, :few]
    dist = np.take_along_axis(d, near, 1)
    order = np.argsort(dist, 1, kind="stable")
    near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
    taken = np.zeros(near.shape, bool)
    taken[:, 0] = True
    for j in range(1, few):
        ok = (dist[:, j] <= NEAR**2 * dist[:, 0]) & (taken.sum(1) < COPIES)
        for i in range(j):  # not if a list already taken is much nearer to this centroid than the vector is
            ok &= ~taken[:, i] | (((c[near[:, j]] - c[near[:, i]]) ** 2).sum(1) >= APART**2 * dist[:, j])
        taken[:, j] = ok
    return near, taken


def _posted(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """Rows of the lists: each vector in those that hold it."""
    c, _, longest = index.value
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            near, taken = lists_of(_lifted(_matrix(part.column(1)), longest), c)
            row, col = np.nonzero(taken)
            yield pa.record_batch({"list": pa.array(near[row, col].astype(np.int32)), "vec_id": part.column(0).take(pa.array(row)), "vector": part.column(1).take(pa.array(row))})


def _probed(batches: Iterator[pa.RecordBatch], index, probes, k: int) -> Iterator[pa.RecordBatch]:
    """The k best vectors of the task for each probe, with place and ratio of the nearest list that holds them."""
    c, _, longest = index.value
    keys, q = probes.value
    d = _distances(np.column_stack((q, np.zeros(len(q)))), c)
    place = np.argsort(np.argsort(d, 1, kind="stable"), 1, kind="stable")
    ratio = np.sqrt(d / np.maximum(d.min(1), np.finfo(float).tiny)[:, None])
    best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * len(q)
    edge = np.full(len(q), -np.inf)
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            ids, x = part.column(0).to_numpy(), _matrix(part.column(1))
            s = q @ x.T
            s[keys[:, None] == ids[None, :]] = -np.inf
            able = (s >= edge[:, None]) & (s > -np.inf)
            used = np.flatnonzero(able.any(0))
            at = np.zeros(len(ids), int)
            at[used] = np.arange(len(used))
            if len(used):
                near, taken = lists_of(_lifted(x[used], longest), c)
            for i in np.flatnonzero(able.any(1)):
                col = np.flatnonzero(able[i])
                col = col[np.lexsort((ids[col], -s[i, col]))][:k]
                held, own = near[at[col]], taken[at[col]]
                new = (s[i, col], ids[col], np.where(own, place[i][held], len(c)).min(1), np.where(own, ratio[i][held], np.inf).min(1))
                score, key, *rest = (np.concatenate(y) for y in zip(best[i], new, strict=True))
                order = np.lexsort((key, -score))[:k]
                best[i] = (score[order], key[order], *(y[order] for y in rest))
                if len(order) == k:
                    edge[i] = best[i][0][-1]
    columns = [np.concatenate(y) for y in zip(*best, strict=True)]
    yield pa.record_batch({"query_id": np.repeat(keys, [len(b[0]) for b in best]), "vec_id": columns[1], "score": columns[0], "place": columns[2], "ratio": columns[3]})


def _reach(place: np.ndarray, ratio: np.ndarray) -> tuple[float, int]:
    """Least ratio of distances, and least number of lists within it, that reach the shares WITHIN and AIM of the neighbours."""
    within = min(float(np.sort(ratio)[int(np.ceil(WITHIN * len(ratio))) - 1]) * (1 + 1e-9), 1e6)
    found = np.sort(np.where(ratio <= within, place, np.iinfo(np.int64).max))
    return within, int(found[int(np.ceil(AIM * len(found))) - 1]) + 1


def reading(rows: DataFrame, asked: DataFrame, index, k: int) -> tuple[float, int]:
    """Ratio and number of the lists to read, by the exact neighbours of a bounded number of the queries."""
    taken = asked.orderBy(F.xxhash64("query_id", F.lit(11)), "query_id").limit(PROBES).toArrow().combine_chunks()
    if not taken.num_rows:
        return 1.0, LEAST_READ
    probes = rows.sparkSession.sparkContext.broadcast((taken.column("query_id").to_numpy().astype(np.int64), _matrix(taken.column("query").combine_chunks())))
    found = rows.mapInArrow(partial(_probed, index=index, probes=probes, k=k), "query_id long, vec_id long, score double, place long, ratio double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.distinct().withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("place", "ratio").toArrow()
    if not found.num_rows:
        return 1.0, LEAST_READ
    return _reach(found.column("place").to_numpy(), found.column("ratio").to_numpy())


def _routed(batches: Iterator[pa.RecordBatch], index, within: float, most: int) -> Iterator[pa.RecordBatch]:
    """The lists that each query reads."""
    c, graph, _ = index.value
    most = max(most, LEAST_READ)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            q = _matrix(part.column(1))
            ids, d = graph_search(np.column_stack((q, np.zeros(len(q)))), c, graph, max(BEAM, most))
            read = d <= within**2 * d[:, :1]
            read[:, :LEAST_READ] = True
            read[:, most:] = False
            read &= ids >= 0
            row, col = np.nonzero(read)
            yield pa.record_batch({"list": pa.array(ids[row, col].astype(np.int32)), "place": pa.array(col.astype(np.int32)), "query_id": part.column(0).take(pa.array(row)), "query": part.column(1).take(pa.array(row))})


def _best(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vectors of the block for each query of the run, of those that score the query's least score or more."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(queries) and len(block):
        block = block.sort_values("vec_id", kind="stable")
        ids = block["vec_id"].to_numpy()
        x = np.stack(block["vector"].to_numpy()).astype(np.float64).T.copy()
        for lo in range(0, len(queries), 32):
            part = queries.iloc[lo : lo + 32]
            q = np.stack(part["query"].to_numpy()).astype(np.float64)
            s = q[:, 0, None] * x[0]
            for j in range(1, len(x)):
                s += q[:, j, None] * x[j]
            for key, least, own in zip(part["query_id"].to_numpy(), part["least"].to_numpy(), s, strict=True):
                own = np.where(ids == key, -np.inf, own)
                if len(own) > 2 * k:
                    edge = np.partition(own, len(own) - k)[len(own) - k]
                    some = np.flatnonzero(own >= edge)
                else:
                    some = np.arange(len(own))
                some = some[np.argsort(-own[some], kind="stable")][:k]
                some = some[(own[some] > -np.inf) & (own[some] >= least)]
                out.append((np.full(len(some), key), ids[some], own[some]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
    return pd.DataFrame({"query_id": np.array(columns[0], np.int64), "vec_id": np.array(columns[1], np.int64), "score": np.array(columns[2], float)})


def _searched(routes: DataFrame, lists: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each block of each query's lists; routes has list, query_id, query, least."""
    shape = sizes.join(routes.groupBy("list").agg(F.ceil(F.count("*") / RUN).alias("runs")), "list")
    right = lists.join(F.broadcast(shape), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
    left = routes.join(F.broadcast(shape), "list").withColumn("run", F.pmod(F.xxhash64("query_id"), "runs")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = left.selectExpr("list as list", "block as block", "run as run", "query_id", "query", "least")
    right = right.selectExpr("list as list", "block as block", "run as run", "vec_id", "vector")
    by = ("list", "block", "run")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda a, b: _best(a, b, k), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, replicas once."""
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): rows with an id whose vector is not zero, without null and non-finite parts, as long as most."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).filter("vec_id is not null and vector is not null")
    rows = rows.filter("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x != 0)")
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (length[0] if length else 0))


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, sample: int = SAMPLE, aim: int = LIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row of queries among the rows of vectors with other ids.

    Both have vec_id and embedding. Ties go to the smaller vec_id; rows that repeat an id and a vector count once.
    What takes no part: see usable. Queries with fewer than k results in their lists read all lists, so
    they get k, or all candidates if there are fewer. Empty tables give an empty table.
    """
    rows = usable(vectors)
    n, longest, length = rows.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.max(F.size("vector"))).first()
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable(queries).filter(F.size("vector") == length).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    longest = float(np.sqrt(longest))
    taken = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    c = balanced_cells(_lifted(_matrix(taken), longest), int(min(MOST_LISTS, max(1, n // aim))))
    index = spark.sparkContext.broadcast((c, neighbour_graph(c), longest))
    kind = vectors.schema["embedding"].dataType.simpleString()
    within, most = reading(rows, asked, index, k)
    lists = store.stored(rows.mapInArrow(partial(_posted, index=index), f"list int, vec_id long, vector {kind}"), "lists")
    routes = store.stored(asked.mapInArrow(partial(_routed, index=index, within=within, most=most), f"list int, place int, query_id long, query {queries.schema['embedding'].dataType.simpleString()}"), "routes")
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # The nearest lists give each query a least score; from the others only vectors that reach it come.
    near = store.stored(_searched(routes.filter(F.col("place") < FIRST_READ).withColumn("least", F.lit(float("-inf"))), lists, sizes, k), "near")
    least = _ranked(near, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    far = routes.filter(F.col("place") >= FIRST_READ).join(least, "query_id", "left").fillna({"least": float("-inf")})
    found = store.stored(_ranked(near.unionByName(_searched(far, lists, sizes, k)), k), "found")
    full = found.filter(F.col("rank") == min(k, max(n - 1, 1))).select("query_id")
    short = store.stored(asked.join(full, "query_id", "left_anti"), "short")
    if not short.limit(1).count():
        return found
    every = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(c) - 1))))
    rest = _ranked(_searched(every.withColumn("least", F.lit(float("-inf"))), lists, sizes, k), k)
    return found.join(full, "query_id", "left_semi").unionByName(rest)
