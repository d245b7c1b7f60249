"""The prefix-filtered join of windows with documents for benchmarks of any size: windows, tokens and places are tables.

Three passes over the documents, however many windows there are: tokens counted, places of prefix tokens found, and results
added. A bit filter of bounded size keeps shingles that no window has out of the exchanges; joins drop what it lets through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm import store
from meshframe.llm.words import ALNUM, chunks, grams

#: Bits of a filter: 8 for each token, within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 16, 28
#: Tokens that a task counts before it sends their sums on, and rows of words that it sends at once.
BUFFER, ROWS = 1 << 20, 1 << 14
#: Places of a token that meet its windows in one task.
SPOKES = 50_000


def _runs(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """A list column whose i-th value is h[start[i]:start[i] + length[i]]."""
    ends = np.cumsum(length)
    values = h[np.repeat(start - ends + length, length) + np.arange(int(length.sum()))]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.view(np.int64)))


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for part, h, at in chunks(batches, "text", ALNUM, True):
        n = np.diff(at)
        count = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(n)), count)
        start = at[item] + np.arange(len(item)) - (np.cumsum(count) - count)[item]
        for lo in range(0, len(item), ROWS):
            own = slice(lo, lo + ROWS)
            yield pa.record_batch({"words": _runs(h, start[own], np.minimum(n, window)[item[own]]), "item_id": part.column(0).take(pa.array(item[own]))})


def _tokens(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The shingles of each window, by their offset in it."""
    for batch in batches:
        words = batch.column(0)
        h, n = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        first, sizes = np.cumsum(n) - n, np.minimum(n, shingle)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            count = n[own] - size + 1
            row = np.repeat(own, count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            token = grams(h, int(size))[first[row] + offset]
            yield pa.record_batch({"words": words.take(pa.array(row)), "size": pa.array(np.full(len(row), size, np.int32)), "token": pa.array(token.view(np.int64)), "offset": pa.array(offset.astype(np.int32))})


def _filter(tokens: DataFrame):
    """A broadcast (bits, words): a bit for the leading bits of each distinct token."""
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * tokens.count()).bit_length()))
    cell = F.shiftrightunsigned("token", 64 - bits).alias("cell")
    held = tokens.select(cell).selectExpr("cast(cell div 64 as int) word", "shiftleft(1L, cast(cell % 64 as int)) bit").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[held["word"].to_numpy()] = held["bit"].to_numpy().view(np.uint64)
    return tokens.sparkSession.sparkContext.broadcast((bits, words))


def _found(h: np.ndarray, at: np.ndarray, size: int, held: tuple[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles inside one text begin that the filter lets through, and their hashes."""
    bits, words = held
    g = grams(h, size)
    cell = g >> np.uint64(64 - bits)
    p = np.flatnonzero(words[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1))
    p = p[p + size <= at[np.searchsorted(at, p, side="right")]]
    return p, g[p]


def _summed(size: int, parts: list[np.ndarray]) -> pa.RecordBatch:
    token, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.record_batch({"size": pa.array(np.full(len(token), size, np.int32)), "token": pa.array(token.view(np.int64)), "n": pa.array(n)})


def _counted(batches: Iterator[pa.RecordBatch], held, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, list[np.ndarray]] = {s: [] for s in sizes}
    for _, h, at in chunks(batches, "text", ALNUM, True):
        for size, parts in kept.items():
            parts.append(_found(h, at, size, held.value)[1])
            if sum(map(len, parts)) >= BUFFER:
                yield _summed(size, parts)
                parts.clear()
    for size, parts in kept.items():
        if parts:
            yield _summed(size, parts)


def _placed(batches: Iterator[pa.RecordBatch], held, sizes: list[int], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Places of prefix tokens with the words around them that a window there can reach, inside the text."""
    for part, h, at in chunks(batches, "text", ALNUM, True):
        for size in sizes:
            every, token = _found(h, at, size, held.value)
            reach = window - size if size == shingle else 0  # a smaller size is that of its whole window
            for lo in range(0, len(every), ROWS):
                p = every[lo : lo + ROWS]
                doc = np.searchsorted(at, p, side="right") - 1
                start, stop = np.maximum(at[doc], p - reach), np.minimum(at[doc + 1], p + size + reach)
                yield pa.record_batch({
                    "text_key": part.column(1).take(pa.array(doc)),
                    "size": pa.array(np.full(len(p), size, np.int32)),
                    "token": pa.array(token[lo : lo + ROWS].view(np.int64)),
                    "place": pa.array(p - at[doc]),
                    "lead": pa.array((p - start).astype(np.int32)),
                    "around": _runs(h, start, stop - start),
                })


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words."""
    for part, _, at in chunks(batches, "text", ALNUM, True):
        yield part.append_column("n_words", pa.array(np.diff(at)))


def _prefixes(windows: DataFrame, docs: DataFrame, window: int, shingle: int) -> tuple[DataFrame, list[int]]:
    """(words, size, token, offset, n): each window that can be in a document, with its rarest token and how often documents have it."""
    kind = "words array<long>, size int, token long, offset int"
    tokens = store.stored(windows.select("words").distinct().mapInArrow(partial(_tokens, shingle=shingle), kind), "window-tokens")
    distinct = store.stored(tokens.select("size", "token").distinct(), "tokens")
    sizes = sorted(r[0] for r in distinct.select("size").distinct().collect())
    counted = docs.select("text").mapInArrow(partial(_counted, held=_filter(distinct), sizes=sizes), "size int, token long, n long")
    counts = counted.groupBy("size", "token").agg(F.sum("n").alias("n"))
    best = F.min_by(F.struct("token", "offset", "n"), F.struct("n", "offset")).alias("best")
    met = tokens.join(counts, ["size", "token"]).groupBy("words", "size").agg(best, F.count("*").alias("met"))
    return store.stored(met.filter(F.col("met") == F.size("words") - F.col("size") + 1).select("words", "size", "best.*"), "prefixes"), sizes


def _hits(prefixes: DataFrame, sizes: list[int], docs: DataFrame, window: int, shingle: int) -> DataFrame:
    """(text_key, start, words): where each window is in each distinct text, all its words compared."""
    kind = "text_key string, size int, token long, place long, lead int, around array<long>"
    held = _filter(store.stored(prefixes.select("size", "token").distinct(), "prefix-tokens"))
    places = docs.select("text", F.md5("text").alias("text_key")).mapInArrow(partial(_placed, held=held, sizes=sizes, window=window, shingle=shingle), kind)
    # Copies of a text fold before the exchange; a token with many places meets its windows in several tasks.
    runs = store.stored(prefixes.filter(F.col("n") > SPOKES).select("size", "token", F.ceil(F.col("n") / SPOKES).alias("runs")).distinct(), "hot-tokens")
    left = places.distinct().join(store.side(runs), ["size", "token"], "left").withColumn("run", F.coalesce(F.pmod(F.xxhash64("text_key", "place"), "runs"), F.lit(0)))
    right = prefixes.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / SPOKES), F.lit(1)) - 1)))
    both = left.join(right, ["size", "token", "run"])
    first, length = F.col("lead") - F.col("offset"), F.size("words")
    inside = both.filter((first >= 0) & (first + length <= F.size("around")))
    return inside.filter(F.slice("around", first + 1, length) == F.col("words")).select("text_key", (F.col("place") - F.col("offset")).alias("start"), "words")


def leaking_texts(docs: DataFrame, items: DataFrame, *, window: int, shingle: int) -> DataFrame:
    """(text_key, spans, items) of each distinct text, by its MD5, that has a window of items (item_id string, text): see find_leaks.

    Empty tables and null texts give no rows.
    """
    windows = store.stored(items.select("item_id", "text").mapInArrow(partial(_windows, window=window), "words array<long>, item_id string").distinct(), "windows")
    prefixes, sizes = _prefixes(windows, docs, window, shingle)
    hits = store.stored(_hits(prefixes, sizes, docs, window, shingle), "hits")
    order = Window.partitionBy("text_key").orderBy("start", "stop")
    spans = hits.select("text_key", "start", (F.col("start") + F.size("words")).alias("stop")).distinct()
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= before, 0).otherwise(1)
    spans = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    spans = spans.groupBy("text_key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    named = hits.select("text_key", "words").distinct().join(windows, "words").select("text_key", "item_id").distinct()
    named = named.groupBy("text_key").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return spans.join(named, "text_key")


def with_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with n_words, items and spans of their texts; empty where nothing is found. Found texts are broadcast if they are few and short."""
    found = store.stored(found, "leaks")
    size = found.agg(F.sum(F.size("spans") + F.size("items"))).first()[0] or 0
    sized = docs.mapInArrow(_sized, store.extended(docs, "n_words long"))
    found = F.broadcast(found) if size <= store.MOST_BROADCAST else found
    out = sized.join(found, F.md5(sized["text"]) == found["text_key"], "left").select(*(sized[c] for c in sized.columns), "spans", "items")
    none = {"spans": "cast(array() as array<struct<start:long,stop:long>>)", "items": "cast(array() as array<string>)"}
    return out.withColumns({c: F.coalesce(F.col(c), F.expr(e)) for c, e in none.items()})
