"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document is its set of distinct word shingles. In any one order of shingles, two sets whose Jaccard similarity is at
least the threshold share at least l of the first |x| - t + l shingles of each, t = ceil(threshold * |x|), for every l.
So a longer prefix may demand more matches:

1. In the order of hashes, a sketch of the longest prefixes of all documents tells which shingles can occur twice. A
   document in whose l-prefix fewer than l can is linked with nothing: it goes no further. Equal sets are one class.
   Where the sketch, whose size is bounded, has fewer cells than tokens, these prefixes are exchanged as well, and the same test is
   made exactly.
2. The classes left order their shingles by rarity, by estimates over all of them. Each picks the l of least
   cost: the classes that its prefix's shingles lead to, weighed up by 1 / l for those left to verify.
3. A star round: each class is compared with pivots of the shingles it shares. Buckets of copies shrink to components
   without their pairs.
4. What is left are shingles whose classes lie in different components. They are grouped by the least component of
   each shingle; the classes outside the largest component of a group are compared with all others of the group, in
   blocks of bounded size. Rows grow with the classes and not with their pairs, and no two classes of different
   components that can link are left out, so no link between components is lost.

Comparisons go by signatures, one bit for each residue of the shingles' hashes: the parity of their number. Two sets differ in
as many shingles at least as their signatures differ in bits, so a pair of signatures too far apart is no link; a
signature has a thirtieth of its set's bytes. Of the pairs left, the nearest one for each class and component is verified by
the exact intersection of its sets; where that one is no link, the sets of all members of the component are.

Pairs inside one component need no check: the result is the components. Hashes have 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from meshframe.llm import shared, sketch, store
from meshframe.llm.components import components
from meshframe.llm.words import NOT_SPACE, binaries, chunks, grams, mix

WORDS = 5
#: The similarity as a ratio of integers.
NUMERATOR, DENOMINATOR = 75, 100
#: The longest prefix has this share of the set's size as its l.
DEEPEST = 8
#: Sets in a block that one task verifies against, and the longest run of its probes. Signatures come in larger blocks.
BLOCK, SIGNATURES = 1024, 8192
#: Pivots of a shingle, and the most that a class is compared with.
PIVOTS, COMPARED = 2, 4
#: Classes that one copy of a pivot's set is verified against.
SPOKES = 64
#: The cost of a verification in units of a shingle looked up.
VERIFY = 2
#: Orders of the classes by which pivots are the first ones: keys are hashes, so flipping bits of them is an order of its own.
_ORDERS = [0, *(int(x) for x in mix(np.arange(1, 8, dtype=np.uint64), 9).view(np.int64))]
#: Cells of a row of the shingles' frequency estimates.
RARITY_BITS = 18


def shingle_sets(h: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin. Fewer words: one of them all."""
    g = grams(h, words)
    n = np.diff(at)
    counts = np.where(n >= words, n - words + 1, 0)
    rows = np.repeat(np.arange(len(n)), counts)
    start = np.repeat(at[:-1] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    values = g[start]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        values = np.concatenate((values, [grams(h[at[i] : at[i + 1]], int(n[i]), 11)[0] for i in short]))
        rows = np.concatenate((rows, short))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        new = np.concatenate(([True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])))
        values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(n) + 1))


def _least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return (num * n + den - 1) // den


def _deep(n: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The deepest l of each set, and the places of its prefix."""
    deepest = np.maximum(1, n // DEEPEST)
    size = np.minimum(n, n - _least(n, num, den) + deepest)
    rows = np.repeat(at[:-1] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return size, rows


def _prefix_hashes(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for _, h, at in chunks(iter([batch]), batch.schema.names[0], NOT_SPACE, True):
            values, begin = shingle_sets(h, at, words)
            yield values[_deep(np.diff(begin), begin, num, den)[1]]


_SETS = "n_shingles long, class_key long, shingles binary"


def _classed(h: np.ndarray, at: np.ndarray, words: int, num: int, den: int, seen) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and where each set begins, class keys, and which sets may link with others by the sketch."""
    values, begin = shingle_sets(h, at, words)
    n = np.diff(begin)
    size, rows = _deep(n, begin, num, den)
    cut = np.concatenate(([0], np.cumsum(size)))
    total = np.concatenate(([0], np.cumsum(seen.value.may_repeat(values[rows]))))
    enough = n > 0
    for depth in depths(n):
        end = cut[:-1] + np.minimum(n, n - _least(n, num, den) + depth)
        enough &= total[np.minimum(end, cut[1:])] - total[cut[:-1]] >= depth
    keys = mix(np.add.reduceat(np.append(mix(values, 5), np.uint64(0)), np.minimum(begin[:-1], len(values))) + n.astype(np.uint64), 6)
    return values, begin, np.where(n > 0, keys, np.uint64(0)).view(np.int64), enough


def _sets(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, seen, whole: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Set sizes and class keys of all documents, and the sets of those that may link with others (empty ones if not whole)."""
    for part, h, at in chunks(batches, "text", NOT_SPACE, True):
        values, begin, keys, enough = _classed(h, at, words, num, den, seen)
        n = np.diff(begin)
        some = enough & whole
        blobs = binaries(values[np.repeat(some, n)], np.concatenate(([0], np.cumsum(np.where(some, n, 0)))))
        yield pa.RecordBatch.from_pydict({
            **{c: part.column(part.schema.get_field_index(c)) for c in names}, "n_shingles": pa.array(n.astype(np.int64)), "class_key": pa.array(keys),
            "shingles": pa.compute.if_else(pa.array(enough), blobs, pa.scalar(None, pa.binary())),
        })


def _deep_tokens(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, seen) -> Iterator[shared.Triples]:
    """(token, class, size of the set and place of the token) of the deepest prefixes of sets that may link by the sketch."""
    for _, h, at in chunks(batches, "text", NOT_SPACE, True):
        values, begin, keys, enough = _classed(h, at, words, num, den, seen)
        n = np.diff(begin)
        size = np.where(enough, _deep(n, begin, num, den)[0], 0)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        tokens = values[np.repeat(begin[:-1], size) + place]
        may = seen.value.may_repeat(tokens)
        yield tokens[may], np.repeat(keys, size)[may], (np.repeat(n, size).astype(np.int64) << 32 | place)[may]


def _sharing(found: DataFrame, num: int, den: int) -> DataFrame:
    """The classes (owner, place as in _deep_tokens) that share as many tokens as a link needs, at every depth."""
    rows = found.selectExpr("owner class_key", "place >> 32 n", "place & 4294967295L pos")
    depth = {f: F.expr(f"greatest(1L, n div {DEEPEST * f})") if f else F.lit(1).cast("long") for f in (0, 4, 2, 1)}
    short = F.expr(f"n - ({num} * n + {den - 1}) div {den}")
    shares = rows.groupBy("class_key", "n").agg(*(F.sum((F.col("pos") < short + d).cast("long")).alias(f"d{f}") for f, d in depth.items()))
    able = F.lit(True)
    for f, d in depth.items():
        able = able & (F.col(f"d{f}") >= d)
    return shares.filter(able).select("class_key")


def depths(n: np.ndarray) -> list[np.ndarray]:
    """The values of l that a set of n shingles chooses from."""
    return [np.maximum(1, n // (DEEPEST * f)) if f else np.ones_like(n) for f in (0, 4, 2, 1)]


def _cells(values: np.ndarray, row: int) -> np.ndarray:
    return (mix(values, 301 + row) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 << RARITY_BITS), np.int64)
    for batch in batches:
        for blob in batch.column(0):
            values = np.frombuffer(blob.as_buffer(), np.uint64)
            for row in range(2):
                sums[row] += np.bincount(_cells(values, row), minlength=1 << RARITY_BITS) if len(values) > 1 << 12 else 0
                if len(values) <= 1 << 12:
                    np.add.at(sums[row], _cells(values, row), 1)
    yield pa.record_batch({"cell_row": pa.array([0, 1], pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in sums], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[row] = sums.get(row, 0) + np.frombuffer(zlib.decompress(blob.as_buffer()), np.int64)
    if sums:
        yield pa.record_batch({"cell_row": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def _rarity(sets: DataFrame):
    """Broadcast count-min rows of all shingles of the classes: 4 MB, whatever the input."""
    kind = "cell_row int, counts binary"
    got = sets.select("shingles").mapInArrow(_frequencies, kind).repartition("cell_row").mapInArrow(_summed, kind).toArrow()
    rows = [np.zeros(1 << RARITY_BITS, np.int64) for _ in range(2)]
    for row, blob in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        rows[row] = np.frombuffer(blob, np.int64)
    return sets.sparkSession.sparkContext.broadcast(rows)


def _tokens(batches: Iterator[pa.RecordBatch], rarity, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The prefix of each class, in the order of rarity, as deep as costs least."""
    counts = rarity.value
    mean = counts[0].mean()
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("n")).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + (1 << 18), side="right")))
            part, n = batch.slice(lo, hi - lo), sizes[lo:hi]
            lo = hi
            values = np.frombuffer(b"".join(part.column(part.schema.get_field_index("shingles")).to_pylist()), np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            often = np.minimum(*(c[_cells(values, i)] for i, c in enumerate(counts)))
            rank = np.maximum(0, np.log2(np.maximum(often, 1) / (2 * mean + 8)).astype(np.int64))
            order = np.lexsort((values, rank, row))
            values, often = values[order], np.maximum(often[order] - mean, 1)
            begin = np.concatenate(([0], np.cumsum(n)))
            sums = np.concatenate(([0], np.cumsum(often)))
            least = _least(n, num, den)
            options = np.array(depths(n))
            stops = begin[:-1] + np.minimum(n, n - least + options)
            cost = (sums[stops] - sums[begin[:-1]]) * (1 + VERIFY / options)
            best = cost.argmin(0)
            depth, stop = options[best, np.arange(len(n))], stops[best, np.arange(len(n))]
            size = stop - begin[:-1]
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            take = pa.array(np.repeat(np.arange(len(n)), size))
            yield pa.record_batch({
                "token": pa.array(values[np.repeat(begin[:-1], size) + place].view(np.int64)), "class_key": part.column(part.schema.get_field_index("class_key")).take(take),
                "depth": pa.array(np.repeat(depth, size).astype(np.int32)),
            })


def _signature(values: np.ndarray) -> bytes:
    """Parities of the hashes by residue: two bits or more a hash, a power of two of them."""
    bits = 1 << max(6, int(2 * len(values) - 1).bit_length())
    at = (mix(values, 7) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [_signature(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(2)]
        yield pa.record_batch({"class_key": batch.column(0), "n": batch.column(1), "signature": pa.array(blobs, pa.binary())})


def _folded(signature: np.ndarray, size: int) -> np.ndarray:
    """Signatures (rows of bytes) in fewer bytes: parities of residues add up."""
    while signature.shape[-1] > size:
        half = signature.shape[-1] // 2
        signature = signature[..., :half] ^ signature[..., half:]
    return signature


def _apart(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bits in which each signature differs from that of the other side."""
    size = min(own.shape[-1], others.shape[-1])
    differ = np.ascontiguousarray(_folded(own, size) ^ _folded(others, size))
    return np.bitwise_count(differ.view(np.uint64)).sum(-1, dtype=np.int64)


class _Held:
    """Signatures of several widths, each width in one array."""

    def __init__(self, signatures: list[bytes]):
        self.width = np.array([len(x) for x in signatures], np.int64)
        self.place = np.zeros(len(signatures), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.frombuffer(b"".join(signatures[i] for i in at), np.uint8).reshape(len(at), w)

    def apart(self, i: np.ndarray, other: _Held, j: np.ndarray) -> np.ndarray:
        """Bits in which the i-th signatures of this side differ from the j-th ones of the other."""
        out = np.zeros(len(i), np.int64)
        both = self.width[i] << 32 | other.width[j]
        for key in np.unique(both).tolist():
            at = np.flatnonzero(both == key)
            x, y = self.rows[key >> 32], other.rows[key & 0xFFFFFFFF]
            step = max(1, (1 << 22) // max(x.shape[1], y.shape[1]))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                out[some] = _apart(x[self.place[i[some]]], y[other.place[j[some]]])
        return out


def _may_link(n: int, others: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and others shingles can link if they differ in apart of them or more."""
    both = n + others
    return ((den + num) * (both - apart) >= 2 * num * both) & (den * np.minimum(n, others) >= num * np.maximum(n, others))


def _pairs_near(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that may link, with the bits that they are apart."""
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
        x, y = _Held(get("a_signature").to_pylist()), _Held(get("b_signature").to_pylist())
        apart = x.apart(np.arange(batch.num_rows), y, np.arange(batch.num_rows))
        near = _may_link(get("a_n").to_numpy(), get("b_n").to_numpy(), apart, num, den)
        yield pa.record_batch({"a": get("a"), "b": get("b"), "apart": pa.array(apart)}).filter(pa.array(near, pa.bool_()))


def _near(probes: pd.DataFrame, block: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """For each probe, the nearest of the set's members in the same place, for each other component that holds one which may link."""
    names, found = ["target", "block", "run"], []
    if len(probes) and len(block):
        block = block.sort_values(names, kind="stable")
        starts = block[names].drop_duplicates().assign(lo=lambda x: block.index.get_indexer(x.index))
        starts["hi"] = np.append(starts["lo"].to_numpy()[1:], len(block))
        probes = probes.merge(starts, on=names)
        ours, theirs = _Held(probes["a_signature"].tolist()), _Held(block["b_signature"].tolist())
        keys, roots, sizes = (block[c].to_numpy() for c in ("b", "b_root", "b_n"))
        own_key, own_root, own_size, lo, many = probes["a"].to_numpy(), probes["a_root"].to_numpy(), probes["a_n"].to_numpy(), probes["lo"].to_numpy(), (probes["hi"] - probes["lo"]).to_numpy()
        ends = np.cumsum(many)
        at = 0
        while at < len(probes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + (1 << 18), side="right")))
            i = np.repeat(np.arange(at, to), many[at:to])
            j = np.arange(len(i)) + np.repeat(lo[at:to] - ends[at:to] + many[at:to] + (ends[at] - many[at]), many[at:to])
            able = (roots[j] != own_root[i]) & (den * np.minimum(own_size[i], sizes[j]) >= num * np.maximum(own_size[i], sizes[j]))
            i, j = i[able], j[able]
            apart = ours.apart(i, theirs, j)
            near = _may_link(own_size[i], sizes[j], apart, num, den)
            part = pd.DataFrame({"a": own_key[i[near]], "a_root": own_root[i[near]], "b": keys[j[near]], "b_root": roots[j[near]], "apart": apart[near]})
            found.append(part.sort_values(["apart", "b"]).drop_duplicates(["a", "b_root"]))
            at = to
    return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "a_root", "b", "b_root", "apart")})


def _pairs_linked(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a_set", "b_set")]
        linked = []
        for x, y in zip(*sets, strict=True):
            common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            linked.append(den * common >= num * ((len(x) + len(y)) // 8 - common))
        names = [c for c in batch.schema.names if c not in ("a_set", "b_set", "run")]
        yield batch.select(names).append_column("linked", pa.array(linked, pa.bool_()))


def _verified(probes: pd.DataFrame, block: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """A link of each probe with a set of the block for each component there; by exact intersection sizes."""
    a, b = [], []
    sets = [np.frombuffer(x, np.uint64) for x in block["b_set"]]
    sizes, keys, roots = np.array([len(s) for s in sets]), block["b"].to_numpy(), block["b_root"].to_numpy()
    if len(sets) and len(probes):
        owner = np.repeat(np.arange(len(sets)), sizes)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for key, root, raw in zip(probes["a"], probes["a_root"], probes["a_set"], strict=True):
            own = np.frombuffer(raw, np.uint64)
            lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            common = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero((den * common >= num * (sizes + len(own) - common)) & (roots != root))
            hit = hit[np.unique(roots[hit], return_index=True)[1]]
            a.extend([key] * len(hit))
            b.extend(keys[hit].tolist())
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _dealt(pairs: DataFrame, members: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Probes (target, a, a_root) and members (target, b, b_root) with block and run: members in blocks of about size, probes to every block of their target in runs of four times as many.

    part is the group of small blocks, or part of a large one, that one call compares: about size rows of each side.
    """
    blocks = members.groupBy("target").agg(F.ceil(F.count("*") / size).alias("blocks"), F.count("*").alias("members"))
    runs = pairs.groupBy("target").agg(F.ceil(F.count("*") / (4 * size)).alias("runs"))
    shape = store.stored(blocks.join(runs, "target"), "shape")
    rows = shape.agg(F.sum(F.col("members") * F.col("runs"))).first()[0] or 0
    shape = store.side(shape.drop("members"))
    right = members.join(shape, "target").withColumn("block", F.pmod(F.xxhash64("b"), "blocks")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
    left = pairs.join(shape, "target").withColumn("run", F.pmod(F.xxhash64("a"), "runs")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.pmod(F.xxhash64("target", "block", "run"), F.lit(rows // size + 1))
    place = ("part as part", "target as target", "block as block", "run as run")  # new names for the cogroups
    return left.withColumn("part", part).selectExpr(*place, "a", "a_root"), right.withColumn("part", part).selectExpr(*place, "b", "b_root")


def _nearest(pairs: DataFrame, members: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """(a, a_root, b, b_root, apart): for each probe and component of its targets that may link with it, the nearest member."""
    left, right = _dealt(pairs, members, SIGNATURES)
    side = lambda x: signatures.select(F.col("class_key").alias(x), F.col("n").alias(f"{x}_n"), F.col("signature").alias(f"{x}_signature"))
    left, right = left.join(side("a"), "a"), right.join(side("b"), "b")
    kind = "a long, a_root long, b long, b_root long, apart long"
    found = left.groupBy("part").cogroup(right.groupBy("part")).applyInPandas(lambda x, y: _near(x, y, num, den), kind)
    return found.groupBy("a", "a_root", "b_root").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", "a_root", "best.b", "b_root", "best.apart")


def _links(pairs: DataFrame, members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of the classes of pairs (target, a, a_root) with the members (target, b, b_root) of their targets that have another root."""
    left, right = _dealt(pairs, members, BLOCK)
    left = left.join(sets.select(F.col("class_key").alias("a"), F.col("shingles").alias("a_set")), "a")
    right = right.join(sets.select(F.col("class_key").alias("b"), F.col("shingles").alias("b_set")), "b")
    by = ("target", "block", "run")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda x, y: _verified(x, y, num, den), "a long, b long")


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The stored pairs (a, b, ...) with linked, by their sets. A pivot b of many pairs is copied for each SPOKES of them."""
    runs = store.stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / SPOKES).alias("runs")), "pivots")
    salted = pairs.join(store.side(runs), "b").withColumn("run", F.pmod(F.xxhash64("a"), "runs")).drop("runs")
    ours = sets.select(F.col("class_key").alias("a"), F.col("shingles").alias("a_set")).join(store.side(store.stored(salted, "spokes")), "a")
    theirs = sets.select(F.col("class_key").alias("b"), F.col("shingles").alias("b_set")).join(store.side(runs), "b").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1))).drop("runs")
    kind = StructType([*(f for f in pairs.schema.fields), StructField("linked", BooleanType())])
    out = ours.join(theirs.hint("shuffle_hash"), ["b", "run"]).select(*pairs.columns, "a_set", "b_set")
    return out.mapInArrow(partial(_pairs_linked, num=num, den=den), kind)


def _star(led: DataFrame, signatures: DataFrame, sets: DataFrame, num: int, den: int, pivots: int, compared: int) -> DataFrame:
    """Links (a, b) of classes with one of the pivots of the shingles that they share."""
    near = led.select("class_key", "depth", *(f"p{i}" for i in range(pivots))).repartition("class_key")
    near = near.select("class_key", "depth", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(pivots))))).alias("pivot")).filter("class_key != pivot")
    near = near.groupBy("class_key", "pivot").agg(F.count("*").alias("shared"), F.min("depth").alias("depth")).filter("2 * shared >= depth").drop("depth")
    best = F.row_number().over(Window.partitionBy("class_key").orderBy(F.desc("shared"), "pivot"))
    pairs = near.withColumn("best", best).filter(F.col("best") <= compared).select(F.col("class_key").alias("a"), F.col("pivot").alias("b"))
    side = lambda x: signatures.select(F.col("class_key").alias(x), F.col("n").alias(f"{x}_n"), F.col("signature").alias(f"{x}_signature"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(partial(_pairs_near, num=num, den=den), "a long, b long, apart long")
    pairs = store.stored(pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", "best.b"), "pairs")
    return _checked(pairs, sets, num, den).filter("linked").select("a", "b")


def similar_components(docs: DataFrame, *, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, pivots: int = PIVOTS, compared: int = COMPARED) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    component_id is the least doc_id that links reach. Links are pairs of shingle sets with
    den * intersection >= num * union. Null and empty texts, and texts without words, have no shingles and link with
    nothing, not even each other. Rows that repeat a doc_id are one document if their sets are equal; a doc_id with
    several texts connects the components of all of them only if they link. Rows without a doc_id keep a null
    component_id, unless they link with one that has an id. An empty table gives an empty table. doc_id may have any
    type that has an order, structs too; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    expected = sketch.text_bytes(docs, "text") // 12
    seen = sketch.repeats(docs, "text", partial(_prefix_hashes, words=words, num=num, den=den), expected)
    crowded = sketch.crowded(expected)
    make = partial(_sets, words=words, num=num, den=den, seen=seen, whole=not crowded, names=["doc_id", "text_key"])
    rows = docs.mapInArrow(make, StructType([docs.schema["doc_id"], docs.schema["text_key"], *StructType.fromDDL(_SETS).fields]))
    rows = store.stored(rows.withColumn("row_no", F.monotonically_increasing_id()), "sets")
    able = rows.filter("shingles is not null")
    if crowded:  # sets are made for the classes that share tokens enough with others, of one text each
        known = shared.repeated(docs.select("text"), partial(_deep_tokens, words=words, num=num, den=den, seen=seen), apart=True)
        able = able.join(store.side(store.stored(_sharing(known, num, den), "sharing")), "class_key", "left_semi")
        chosen = store.stored(able.groupBy("class_key").agg(F.min("text_key").alias("text_key")).select("text_key"), "chosen")
        texts = docs.select("text", "text_key").join(store.side(chosen), "text_key", "left_semi").select("text")
        made = texts.mapInArrow(partial(_sets, words=words, num=num, den=den, seen=seen, whole=True, names=[]), _SETS).filter("shingles is not null")
        sets = store.stored(made.groupBy("class_key").agg(F.first("n_shingles").cast("int").alias("n"), F.first("shingles").alias("shingles")), "class-sets")
    else:
        first = store.stored(able.groupBy("class_key").agg(F.min("row_no").alias("row_no")).select("row_no"), "classes")
        sets = rows.join(store.side(first), "row_no", "left_semi").select("class_key", F.col("n_shingles").cast("int").alias("n"), "shingles")
    signatures = store.stored(sets.mapInArrow(_signatures, "class_key long, n int, signature binary"), "signatures")
    tokens = sets.mapInArrow(partial(_tokens, rarity=_rarity(sets), num=num, den=den), "token long, class_key long, depth int")
    pick = [F.min(F.col("class_key").bitwiseXOR(F.lit(o))).bitwiseXOR(F.lit(o)).alias(f"p{i}") for i, o in enumerate(_ORDERS[:pivots])]
    hubs = tokens.groupBy("token").agg(*pick, F.count("*").alias("classes")).filter("classes > 1").drop("classes")
    led = store.stored(tokens.join(hubs, "token"), "prefixes")
    edges = _star(led, signatures, sets, num, den, pivots, compared)
    roots = store.stored(components(edges), "roots")

    # The exact rest: shingles whose classes lie in different components. A shingle's least root is its key; two classes
    # that share shingles share their keys, and some key has at least its part of the matches that they need.
    mine = led.select("token", "class_key", "depth").join(store.side(roots).withColumnRenamed("node", "class_key"), "class_key", "left").withColumn("root", F.coalesce("root", "class_key"))
    apart = mine.groupBy("token").agg(F.min("root").alias("target"), F.max("root").alias("hi"), F.min("depth").alias("least")).filter("target < hi").drop("hi")
    keyed = mine.join(apart, "token").groupBy("class_key", "root", "target").agg(F.count("*").alias("found"), F.min(F.least("depth", "least")).alias("need"))
    keyed = store.stored(keyed, "keyed")
    needs = store.stored(keyed.groupBy("class_key").agg(F.count("*").alias("keys"), F.min("need").alias("need")), "needs")
    keyed = store.stored(keyed.drop("need").join(store.side(needs), "class_key").filter("found * keys >= need").select("target", "class_key", "root"), "groups")
    sizes = keyed.groupBy("target", "root").agg(F.count("*").alias("members"))
    main = sizes.groupBy("target").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    keyed = keyed.join(store.side(store.stored(main, "groups-main")), "target")
    pairs = keyed.filter("root != main").select("target", F.col("class_key").alias("a"), F.col("root").alias("a_root"))
    members = keyed.select("target", F.col("class_key").alias("b"), F.col("root").alias("b_root"))
    nearest = store.stored(_nearest(pairs, members, signatures, num, den), "nearest")
    checked = store.stored(_checked(nearest, sets, num, den), "checked")
    # Where the nearest member of a component is no link, another one may be.
    open_ = checked.filter("not linked").select("a", "b_root").distinct()
    again = keyed.join(store.side(store.stored(open_, "open")).withColumnRenamed("a", "class_key"), "class_key").select("target", F.col("class_key").alias("a"), F.col("root").alias("a_root"), "b_root").distinct()
    held = store.stored(again.select("target", "b_root").distinct(), "held")
    others = members.join(store.side(held), ["target", "b_root"], "left_semi")
    late = _links(again.select("target", "a", "a_root").distinct(), others, sets, num, den)
    edges = checked.filter("linked").select("a", "b").unionByName(late)
    return _labelled(rows, roots, edges)


def _labelled(rows: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows with the least doc_id of their component: by roots, and by edges between classes of different roots."""
    up = lambda x: store.side(roots).select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    joined = edges.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    above = store.stored(components(joined), "above")
    classes = rows.filter("n_shingles > 0").groupBy("class_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = classes.join(roots.withColumnRenamed("node", "class_key"), "class_key", "left").withColumn("root", F.coalesce("root", "class_key"))
    classes = classes.join(store.side(above).select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    classes = store.stored(classes, "labels")
    tops = classes.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("copies")).filter("copies > 1").select("root", "component_id")
    labels = store.side(store.stored(classes.join(tops, "root").select("class_key", "component_id"), "components"))
    keyed = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_key")).alias("class_key"))
    return keyed.join(labels, "class_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
