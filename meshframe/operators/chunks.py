"""Tables of chunks: which boxes of a dataset exist, how they join, merge and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.functions.arrays import unravel
from meshframe.operators.numbering import earlier_max, exclusive_sum
from meshframe.operators.spatial import meeting
from meshframe.sources import scratch


def overlap(requests: DataFrame, chunks: DataFrame, rank: int, keys: Sequence[str] = ("path",)) -> DataFrame:
    """The intersections of requested boxes with chunks, each pair once: offset and extent of each, with r_offset and c_offset.

    Both sides are dealt into cells of all axes: see spatial.meeting. Further columns of the chunks come with the prefix c_.
    """
    r = requests.select(*keys, *(c for c in requests.columns if c not in (*keys, "offset", "extent")), F.col("offset").alias("r_offset"), F.col("extent").alias("r_extent"))
    c = chunks.select(*keys, F.col("offset").alias("c_offset"), F.col("extent").alias("c_extent"), *(F.col(x).alias(f"c_{x}") for x in chunks.columns if x not in (*keys, "offset", "extent")))
    stop = lambda side: F.zip_with(f"{side}_offset", f"{side}_extent", lambda o, e: o + e)
    both = meeting(r.withColumns({"l_lo": F.col("r_offset"), "l_hi": stop("r")}), c.withColumns({"r_lo": F.col("c_offset"), "r_hi": stop("c")}), rank, keys)
    start = [F.greatest(F.get("l_lo", d), F.get("r_lo", d)) for d in range(rank)]
    end = [F.least(F.get("l_hi", d), F.get("r_hi", d)) for d in range(rank)]
    return both.withColumns({"offset": F.array(*start), "extent": F.array(*(b - a for a, b in zip(start, end, strict=True)))}).drop("l_lo", "l_hi", "r_lo", "r_hi")


def provenance(chunks: DataFrame, rank_table: DataFrame) -> DataFrame:
    """Chunks with their writer's host, null if unknown; negative writers count as 0. The table is small: one row a writer."""
    known = chunks.withColumn("source_id", F.greatest(F.coalesce("source_id", F.lit(0)), F.lit(0)))
    return known.join(rank_table.select("source_id", "host"), "source_id", "left")


def rank_host(line: Column | str) -> Column:
    """The host of a row of a rank table: the characters before the first NUL; null if the row doesn't end with one."""
    line = F.col(line) if isinstance(line, str) else line
    return F.when(line.endswith("\0"), F.split(line, "\0")[0])


def common_grid(chunks: DataFrame, shapes: DataFrame) -> DataFrame:
    """(path, axis, offset, width): along each axis the distinct chunk offsets, up to the next one or the shape's end."""
    starts = chunks.select("path", F.posexplode("offset").alias("axis", "offset")).distinct()
    sized = starts.join(shapes.select("path", F.posexplode("shape").alias("axis", "size")), ["path", "axis"])
    after = F.lead("offset").over(Window.partitionBy("path", "axis").orderBy("offset"))
    return sized.select("path", "axis", "offset", (F.coalesce(after, "size") - F.col("offset")).alias("width"))


def joined_offsets(chunks: DataFrame, keys: Sequence[str] = ("iteration", "path"), rank: str = "source_id", seq: str = "seq", extent: str = "n") -> DataFrame:
    """Where each chunk of a joined dimension goes: the extents of lower writers, then of earlier writes of the same."""
    return exclusive_sum(chunks, list(keys), [rank, seq], extent, "joined_offset")


def joined_extent(chunks: DataFrame, axis: int = 0, keys: Sequence[str] = ("path",)) -> DataFrame:
    """The global extent of a joined dimension; RuntimeError through `others` > 1 shows other axes that differ."""
    rest = F.when(F.size("extent") > 1, F.concat(F.slice("extent", 1, axis), F.slice("extent", axis + 2, F.size("extent"))))
    return chunks.groupBy(*keys).agg(F.sum(F.get("extent", axis)).alias("joined_extent"), F.count_distinct(rest).alias("others"))


def sorted_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("path", "offset", "extent")


def merged(blocks_as_cells: DataFrame, keys: Sequence[str], order: str = "write_seq", value: str = "value") -> DataFrame:
    """The cells after all writes: the last write of a cell counts; cells never written are missing.

    An aggregate with a partial step, so a cell that is written over and over is no hot spot.
    """
    return blocks_as_cells.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def extended(old_shape: Sequence[int], new_shape: Sequence[int], kind: str = "array", new_kind: str | None = None) -> list[int]:
    """The shape after an extension; ValueError if the rank changes, an axis shrinks, or data would become constant or empty."""
    new_kind = new_kind or kind
    if len(old_shape) != len(new_shape) and kind != "empty":
        raise ValueError("the rank can't change")
    if any(n < o for o, n in zip(old_shape, new_shape, strict=False)):
        raise ValueError("no axis can shrink")
    allowed = {"array": {"array"}, "constant": {"constant"}, "empty": {"empty", "constant"}}
    if new_kind not in allowed[kind]:
        raise ValueError(f"a dataset that is {kind} can't become {new_kind}")
    return list(new_shape)


def extend(cells: DataFrame, old_shape: Sequence[int], new_shape: Sequence[int], kind: str = "array", new_kind: str | None = None, fill=None, value: str = "value") -> DataFrame:
    """The cells (i0…, value) of a component after an extension, checked as in extended.

    Old cells stay. A constant component (fill given) gets a cell for each new place, made by Spark as a difference of ranges; of an array, new places are left unwritten; an empty one
    that becomes constant gets all its cells.
    """
    shape = extended(old_shape, new_shape, kind, new_kind)
    if fill is None:
        return cells
    rank, n = len(shape), 1
    for s in shape:
        n *= s
    index = unravel("id", shape)
    new = cells.sparkSession.range(n).select(*(x.cast("long").alias(f"i{d}") for d, x in enumerate(index)))
    inside = F.lit(kind != "empty")
    for d in range(rank if kind != "empty" else 0):
        inside = inside & (F.col(f"i{d}") < old_shape[d])
    return cells.unionByName(new.filter(~inside).withColumn(value, F.lit(fill).cast(cells.schema[value].dataType)), allowMissingColumns=True)


#: Cells of a range that the cells of a single axis are dealt into.
RANGE = 65_536


def written_chunks(cells: DataFrame, rank: int, keys: Sequence[str] = ("path",)) -> DataFrame:
    """(keys, offset, extent): the boxes that written cells make up, of which no two can be joined along an axis.

    Runs on the innermost axis come first; then, axis by axis outwards, boxes that are the same in all other axes and follow one another
    become one. The runs of an axis are maximal, so what an outer axis joins opens nothing for an inner one: a pass an axis is enough. Each is one
    exchange by the other axes and a window along this one; no slab or path is ever one row or one group. A single axis: see _line.
    """
    axes = [f"i{d}" for d in range(rank)]
    rows = cells.select(*keys, *axes).distinct()
    if rank == 1:
        # Runs are cut at ranges, which _line joins again.
        rows = rows.withColumn("__range", F.floor(F.col("i0") / RANGE))
        run = F.col("i0") - F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("i0"))
        runs = rows.withColumn("__run", run).groupBy(*keys, "__range", "__run").agg(F.min("i0").alias("__o0"), F.count("*").alias("__e0"))
        return merged_boxes(runs.select(*keys, F.array("__o0").alias("offset"), F.array("__e0").alias("extent")), 1, keys)
    done: list[str] = []
    for d in range(rank - 1, -1, -1):
        rest = [*keys, *axes[:d], *done]
        run = F.col(axes[d]) - F.row_number().over(Window.partitionBy(*rest).orderBy(axes[d]))
        rows = rows.withColumn("__run", run).groupBy(*rest, "__run").agg(F.min(axes[d]).alias(f"__o{d}"), F.count("*").alias(f"__e{d}")).drop("__run")
        done += [f"__o{d}", f"__e{d}"]
    return rows.select(*keys, F.array(*(f"__o{d}" for d in range(rank))).alias("offset"), F.array(*(f"__e{d}" for d in range(rank))).alias("extent"))


def _line(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint boxes of one axis (keys, __o0, __e0), joined where one ends as the next begins.

    The ends rise with the offsets, so the greatest earlier end is that of the box before, and the greatest earlier start of
    a run is the own one: two running maxima by buckets of the axis, so that a path with most of the boxes is many tasks.
    """
    found = earlier_max(boxes.withColumn("__end", F.col("__o0") + F.col("__e0")), list(keys), ["__o0"], "__end", "__last")
    fresh = F.when(~F.col("__o0").eqNullSafe(F.col("__last")), F.col("__o0"))
    found = scratch.cut(found.select(*keys, "__o0", "__e0", fresh.alias("__start")))
    found = earlier_max(found, list(keys), ["__o0"], "__start", "__run")
    found = found.groupBy(*keys, F.coalesce("__start", "__run").alias("__run")).agg(F.min("__o0").alias("__o0"), F.sum("__e0").alias("__e0"))
    return found.drop("__run")


def merged_boxes(boxes: DataFrame, rank: int, keys: Sequence[str] = ("path",), most_rounds: int = 64) -> DataFrame:
    """Disjoint boxes (keys, offset, extent) joined axis by axis, innermost first, wherever runs of them touch in just one axis, until none does.

    Boxes that agree in all other axes are neighbours in order of this one: gaps and islands, by windows. With one axis
    nothing else divides the boxes of a path: see _line.
    """
    shape = [F.get("offset", d).cast("long").alias(f"__o{d}") for d in range(rank)] + [F.get("extent", d).cast("long").alias(f"__e{d}") for d in range(rank)]
    found, count = boxes.select(*keys, *shape), None
    if rank == 1:
        return _line(scratch.cut(found), keys).select(*keys, F.array("__o0").alias("offset"), F.array("__e0").alias("extent"))
    for _ in range(most_rounds):
        for d in range(rank - 1, -1, -1):
            rest = [f"__{x}{i}" for i in range(rank) if i != d for x in "oe"]
            order = Window.partitionBy(*keys, *rest).orderBy(f"__o{d}")
            fresh = F.col(f"__o{d}") != F.lag(F.col(f"__o{d}") + F.col(f"__e{d}")).over(order)
            found = found.withColumn("__run", F.sum(F.coalesce(fresh, F.lit(True)).cast("long")).over(order))
            found = found.groupBy(*keys, *rest, "__run").agg(F.min(f"__o{d}").alias(f"__o{d}"), F.sum(f"__e{d}").alias(f"__e{d}")).drop("__run")
        found = scratch.cut(found)  # rounds would grow the plan
        now = found.count()
        if now == count:
            break
        count = now
    return found.select(*keys, F.array(*(f"__o{d}" for d in range(rank))).alias("offset"), F.array(*(f"__e{d}" for d in range(rank))).alias("extent"))
