"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window (a run of item words) is a record whose tokens are its word shingles, and it is in a document only if all its
tokens are. Tokens are ordered by rarity, counted over all documents, so the rarest one is the necessary prefix:
only its places in the documents are looked at. A token's offset in the window and its place bound where the
window can start (it must lie inside the text), and the words there are compared one by one.

Items are taken in blocks of bounded size, each broadcast; documents are never shuffled. A benchmark of more than a few blocks
is joined by tables instead, with the same rows (leak_join): passes over the documents don't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import leak_join, store
from meshframe.llm.words import ALNUM, chunks, grams, texts, word_hashes

WINDOW = 10
SHINGLE = 5
#: Bytes of item texts of a block; its index takes about 40 times that.
BLOCK_BYTES = 2_000_000
#: Blocks that are broadcast, each for two passes over the documents; a benchmark of more is joined.
MOST_BLOCKS = 2
_BITS = 20


class Block:
    """The windows of some items, their tokens, and the items of each window."""

    def __init__(self, ids: list[str], bodies: list[str | None], window: int):
        data, offs = texts(pa.array(bodies, pa.string()))
        h, at = word_hashes(data, offs, ALNUM, True)
        found: dict[bytes, int] = {}
        self.words, self.items = [], []
        for name, a, b in zip(ids, at[:-1], at[1:], strict=True):
            for s in range(a, max(b - window, a) + 1 if b > a else a):
                own = h[s : min(s + window, b)]
                k = found.setdefault(own.tobytes(), len(found))
                if k == len(self.words):
                    self.words.append(own)
                    self.items.append(set())
                self.items[k].add(name)
        #: By shingle size: sorted distinct token hashes, and for each window its tokens' places in them by offset.
        self.tokens, self.of = {}, []
        own = [(min(SHINGLE, len(w)), grams(w, min(SHINGLE, len(w)))) for w in self.words]
        for size in sorted({s for s, _ in own}):
            self.tokens[size] = np.unique(np.concatenate([g for s, g in own if s == size]))
        self.of = [(s, np.searchsorted(self.tokens[s], g)) for s, g in own]

    def index(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple]:
        """By shingle size: prefix token hashes, where each one's windows begin, the windows and the offsets."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for k, (size, tokens) in enumerate(self.of):
            offset = min(range(len(tokens)), key=lambda o: (counts.get((size, int(tokens[o])), 0), o))
            rows.setdefault(size, []).append((int(tokens[offset]), k, offset))
        out = {}
        for size, found in rows.items():
            token, k, offset = (np.array(x) for x in zip(*sorted(found), strict=True))
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            hashes = self.tokens[size][token[first]]
            out[size] = (hashes, _bitmap(hashes), np.append(first, len(token)), k, offset)
        return out


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, bool)
    bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return bits


def _places(h: np.ndarray, at: np.ndarray, size: int, hashes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles of one of the hashes begin, inside one text each, and which hash it is."""
    g = grams(h, size)
    p = np.flatnonzero(bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
    which = np.minimum(np.searchsorted(hashes, g[p]), len(hashes) - 1)
    ok = hashes[which] == g[p]
    p, which = p[ok], which[ok]
    ok = p + size <= at[np.searchsorted(at, p, side="right")]
    return p[ok], which[ok]


def _token_counts(batches: Iterator[pa.RecordBatch], tokens) -> Iterator[pa.RecordBatch]:
    sums = {s: np.zeros(len(t), np.int64) for s, t in tokens.value.items()}
    bits = {s: _bitmap(t) for s, t in tokens.value.items()}
    for _, h, at in chunks(batches, "text", ALNUM, True):
        for s, t in tokens.value.items():
            sums[s] += np.bincount(_places(h, at, s, t, bits[s])[1], minlength=len(t))
    for s, n in sums.items():
        k = np.flatnonzero(n)
        yield pa.record_batch({"size": pa.array(np.full(len(k), s, np.int32)), "token": pa.array(k.astype(np.int32)), "n": pa.array(n[k])})


_FOUND = "spans array<struct<start:long,stop:long>>, items array<string>, n_words long"


def _probe(batches: Iterator[pa.RecordBatch], block, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds the block's spans, merged with those of earlier blocks, and its items."""
    index, words, items = block.value
    length = np.array([len(w) for w in words])
    padded = np.zeros((len(words), int(length.max()) if len(words) else 1), np.uint64)
    for k, w in enumerate(words):
        padded[k, : len(w)] = w
    for part, h, at in chunks(batches, "text", ALNUM, True):
        starts, wins = [], []
        for size, (hashes, bits, first, win, offset) in index.items():
            p, which = _places(h, at, size, hashes, bits)
            n = first[which + 1] - first[which]
            row = np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            s, k = np.repeat(p, n) - offset[row], win[row]
            doc = np.searchsorted(at, np.repeat(p, n), side="right") - 1
            ok = (s >= at[doc]) & (s + length[k] <= at[doc + 1])
            s, k = s[ok], k[ok]
            for lo in range(0, len(s), 1 << 16):
                a, b = s[lo : lo + (1 << 16)], k[lo : lo + (1 << 16)]
                ok = np.ones(len(a), bool)
                for j in range(padded.shape[1]):
                    inside = length[b] > j
                    ok &= ~inside | (h[np.where(inside, a + j, 0)] == padded[b, j])
                starts.append(a[ok])
                wins.append(b[ok])
        s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        k = np.concatenate(wins) if wins else np.zeros(0, np.int64)
        order = np.argsort(s, kind="stable")
        s, k = s[order], k[order]
        cut = np.searchsorted(s, at)
        spans = part.column(part.schema.get_field_index("spans")).to_pylist()
        named = part.column(part.schema.get_field_index("items")).to_pylist()
        for i in range(part.num_rows):
            if cut[i] < cut[i + 1]:
                own = slice(cut[i], cut[i + 1])
                new = zip((s[own] - at[i]).tolist(), (s[own] - at[i] + length[k[own]]).tolist(), strict=True)
                merged: list[list[int]] = []
                for a, b in sorted([*((x["start"], x["stop"]) for x in spans[i] or []), *new]):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                spans[i] = [{"start": a, "stop": b} for a, b in merged]
                named[i] = sorted({*(named[i] or []), *(x for w in set(k[own].tolist()) for x in items[w])})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_pydict({**{c: part.column(part.schema.get_field_index(c)) for c in names}, "spans": pa.array([x or [] for x in spans], kind), "items": pa.array([x or [] for x in named], pa.list_(pa.string())), "n_words": pa.array(np.diff(at))})


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The columns of docs (with text), then n_words, n_hit, items (the ids as sorted strings) and spans of hit words.

    benchmark has item_id and text. Windows are runs of `window` words of an item, or all its words if it has
    fewer; items without words have none. Null texts have no words. An item without an id counts under the
    empty string; items repeated under one id count once. Without items, or without documents, nothing is hit. Columns
    of docs that clash with the new ones are replaced.
    """
    docs = store.without(docs, "n_words", "n_hit", "items", "spans")
    names, docs = docs.columns, store.plain(docs)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    spark, size = docs.sparkSession, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // block_bytes + 1
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    if n > most_blocks:
        out = leak_join.with_leaks(docs, leak_join.leaking_texts(docs, items, window=window, shingle=SHINGLE))
        return store.named(out.select(*docs.columns, "n_words", hit.alias("n_hit"), "items", "spans"), names)
    out = docs.selectExpr("*", "cast(array() as array<struct<start:long,stop:long>>) spans", "cast(array() as array<string>) items", "0L n_words")
    schema = store.extended(docs, _FOUND)
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()  # about block_bytes
        block = Block([r[0] for r in rows], [r[1] for r in rows], window)
        tokens = spark.sparkContext.broadcast(block.tokens)
        counted = docs.select("text").mapInArrow(partial(_token_counts, tokens=tokens), "size int, token int, n long")
        counts = {(r[0], r[1]): r[2] for r in counted.groupBy("size", "token").agg(F.sum("n")).collect()}
        probed = spark.sparkContext.broadcast((block.index(counts), block.words, block.items))
        out = out.mapInArrow(partial(_probe, block=probed, names=docs.columns), schema)
    return store.named(out.select(*docs.columns, "n_words", hit.alias("n_hit"), "items", "spans"), names)
