"""Fields on grids: cells (a row per grid point) and blocks (a row per chunk, values in an array)."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.functions.arrays import ravel
from meshframe.functions.slicing import Region
from meshframe.operators.spatial import meeting
from meshframe.sources import scratch


def index_columns(rank: int) -> list[str]:
    return [f"i{d}" for d in range(rank)]


def _local(position: Column, extent: Column, rank: int, axis: int) -> Column:
    """The index along an axis inside a block, of a row-major position."""
    below = F.lit(1).cast("long")
    for d in range(axis + 1, rank):
        below = below * F.get(extent, d)
    return F.floor(position / below).cast("long") % F.get(extent, axis)


def blocks_to_cells(blocks: DataFrame, rank: int, value: str = "values", out: str = "value", keep: Sequence[str] = ("iteration",), box: Region | None = None) -> DataFrame:
    """A row for each value of each block, with global indices. With a box, only its values ever become rows: see _boxed."""
    if box is not None:
        return _boxed(blocks, rank, value, out, keep, box)
    cells = blocks.select(*keep, "offset", "extent", F.posexplode(value).alias("__at", out))
    index = {f"i{d}": (F.get("offset", d) + _local(F.col("__at").cast("long"), F.col("extent"), rank, d)).cast("long") for d in range(rank)}
    return cells.select(*keep, *(c.alias(n) for n, c in index.items()), out)


def _boxed(blocks: DataFrame, rank: int, value: str, out: str, keep: Sequence[str], box: Region) -> DataFrame:
    """The values of a box, sliced inside the arrays: blocks that miss the box are left out, and of the others the positions in the box are
    made by strides before any row is. A plane of a block of n**3 cells makes n**2 rows."""
    if 0 in box.extent:
        blocks = blocks.limit(0)
    for d, (o, e) in enumerate(zip(box.offset, box.extent, strict=True)):
        blocks = blocks.filter((F.get("offset", d) < o + e) & (F.get("offset", d) + F.get("extent", d) > o))
    start = {f"__s{d}": F.greatest(F.get("offset", d), F.lit(o)).cast("long") for d, o in enumerate(box.offset)}
    stop = [F.least(F.get("offset", d) + F.get("extent", d), F.lit(o + e)).cast("long") for d, (o, e) in enumerate(zip(box.offset, box.extent, strict=True))]
    cut = blocks.filter(F.col(value).isNotNull()).withColumns(start | {f"__n{d}": s - start[f"__s{d}"] for d, s in enumerate(stop)})

    def cell(k: Column) -> Column:
        index: list[Column] = []
        for d in range(rank - 1, -1, -1):
            index.insert(0, F.col(f"__s{d}") + k % F.col(f"__n{d}"))
            k = F.call_function("div", k, F.col(f"__n{d}"))
        at = F.lit(0).cast("long")
        for d, i in enumerate(index):
            at = at * F.get("extent", d) + (i - F.get("offset", d))
        return F.struct(*(i.alias(f"i{d}") for d, i in enumerate(index)), F.get(value, at.cast("int")).alias(out))

    count = F.lit(1).cast("long")
    for d in range(rank):
        count = count * F.col(f"__n{d}")
    return cut.select(*keep, F.inline(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), cell)))


def cells_to_blocks(cells: DataFrame, widths: Sequence[int], shape: Sequence[int], value: str = "value", keys: Sequence[str] = ("iteration",), out: str = "values") -> DataFrame:
    """Blocks of the widths (-1: the whole axis), edge blocks cut; every cell of the shape must be there once. One shuffle."""
    rank = len(shape)
    widths = [s if w == -1 else w for w, s in zip(widths, shape, strict=True)]
    start = [F.floor(F.col(f"i{d}") / F.lit(w)).cast("long") * F.lit(w) for d, w in enumerate(widths)]
    dealt = cells.select(*keys, F.array(*start).alias("offset"), F.struct(ravel(index_columns(rank), shape).alias("at"), F.col(value).alias("v")).alias("cell"))
    grouped = dealt.groupBy(*keys, "offset").agg(F.sort_array(F.collect_list("cell")).alias("__cells"))
    extent = F.array(*(F.least(F.lit(w), F.lit(s) - F.get("offset", d)).cast("long") for d, (w, s) in enumerate(zip(widths, shape, strict=True))))
    return grouped.select(*keys, "offset", extent.alias("extent"), F.col("__cells.v").alias(out))


def auto_widths(shape: Sequence[int], item_bytes: int, aim: int = 128 << 20, fixed: Sequence[int] = ()) -> list[int]:
    """Widths for blocks of about `aim` bytes: axis 0 is cut first, then the next; fixed axes stay whole."""
    widths = list(shape)
    for d in range(len(shape)):
        if d in fixed:
            continue
        size = prod(widths) * item_bytes
        if size > aim:
            widths[d] = max(1, widths[d] * aim // size)
    return widths


def in_box(cells: DataFrame, box: Region) -> DataFrame:
    for d, (o, e) in enumerate(zip(box.offset, box.extent, strict=True)):
        cells = cells.filter((F.col(f"i{d}") >= o) & (F.col(f"i{d}") < o + e))
    return cells


def load_chunk(cells: DataFrame, box: Region) -> DataFrame:
    """The cells of a box with local indices j0.. and their row-major position; axes picked by integers are left out."""
    axes = [d for d in range(len(box.offset)) if d not in box.dropped]
    found = in_box(cells, box).withColumns({f"j{n}": F.col(f"i{d}") - F.lit(box.offset[d]) for n, d in enumerate(axes)})
    position = ravel([f"j{n}" for n in range(len(axes))], [box.extent[d] for d in axes]) if axes else F.lit(0).cast("long")
    return found.withColumn("position", position)


def grid_block(shape: Sequence[int], grid: Sequence[int]) -> Column:
    """The number of the block of a process grid that a cell is in; ValueError if the grid doesn't divide the shape."""
    if any(s % g for s, g in zip(shape, grid, strict=True)):
        raise ValueError(f"a grid {list(grid)} doesn't divide {list(shape)}")
    return ravel([F.floor(F.col(f"i{d}") / F.lit(s // g)).cast("long") for d, (s, g) in enumerate(zip(shape, grid, strict=True))], grid)


def constant(spark: SparkSession, shape: Sequence[int], value, out: str = "value") -> DataFrame:
    """A constant component as cells: its linear index and the value."""
    return spark.range(prod(shape)).select(F.col("id").alias("linear_index"), F.lit(value).alias(out))


def empty(spark: SparkSession, spark_type: str, rank: int) -> DataFrame:
    """An empty component: typed columns, no rows."""
    return spark.createDataFrame([], ", ".join([*(f"i{d} long" for d in range(rank)), f"value {spark_type}"]))


def densified(cells: DataFrame, shape: Sequence[int], value: str = "value") -> DataFrame:
    """Every cell of the shape; cells that were never written are NaN. TypeError if the values aren't floats."""
    kind = dict(cells.dtypes)[value]
    if kind not in ("float", "double"):
        raise TypeError(f"cells of {kind} can't be left out")
    linear = cells.select(ravel(index_columns(len(shape)), shape).alias("linear_index"), F.struct(value).alias("__v"))
    full = cells.sparkSession.range(prod(shape)).withColumnRenamed("id", "linear_index").join(linear, "linear_index", "left")
    return full.select("linear_index", F.when(F.col("__v").isNull(), F.lit(float("nan")).cast(kind)).otherwise(F.col(f"__v.{value}")).alias(value))


def azimuthal_mode(index: Column | str) -> Column:
    """The mode of a field of axis 0: 0 for the first, then two fields each."""
    index = F.col(index) if isinstance(index, str) else index
    return F.floor((index + 1) / 2).cast("int")


def mode_count(geometry_parameters: Column | str) -> Column:
    """m of parameters such as m=2;imag=+."""
    return F.regexp_extract(geometry_parameters, r"(?:^|;)\s*m\s*=\s*(\d+)", 1).cast("int")


def intensity(*components: Column | str) -> Column:
    """The sum of squares, left to right, in doubles."""
    total = None
    for c in components:
        c = (F.col(c) if isinstance(c, str) else c).cast("double")
        total = c * c if total is None else total + c * c
    return total


def block_intensity(*arrays: str) -> Column:
    """Sums of squares of arrays of equal length, value by value, without exploding them."""
    squares = [F.transform(a, lambda x: x.cast("double") * x.cast("double")) for a in arrays]
    out = squares[0]
    for s in squares[1:]:
        out = F.zip_with(out, s, lambda a, b: a + b)
    return out


def _edges_inside(components: dict[str, DataFrame], rank: int, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, offset, extent, at): for each box of a block, a list for each axis of the edges of any chunk that are inside it, null for none.

    The spans that blocks have along an axis are joined with the edges by cells that fit the spans, so that a block meets just the edges it is cut at.
    """
    boxes = None
    for blocks in components.values():
        own = blocks.filter(F.col(value).isNotNull()).select(*keys, F.col("offset").cast("array<bigint>").alias("offset"), F.col("extent").cast("array<bigint>").alias("extent"))
        boxes = own if boxes is None else boxes.unionByName(own)
    boxes = scratch.cut(boxes.dropna(subset=list(keys)).distinct())  # read for the levels, the edges and the spans
    span = F.explode(F.array(*(F.struct(F.lit(d).alias("axis"), F.get("offset", d).alias("lo"), (F.get("offset", d) + F.get("extent", d)).alias("hi")) for d in range(rank))))
    spans = boxes.select(*keys, span.alias("__s")).select(*keys, "__s.*").distinct()
    edges = spans.select(*keys, "axis", F.explode(F.array("lo", "hi")).alias("at")).distinct().withColumn("l_lo", F.array("at"))
    inner = meeting(edges, spans.withColumns({"r_lo": F.array(F.col("lo") + 1), "r_hi": F.array("hi")}), 1, [*keys, "axis"], points=True)
    lists = scratch.cut(inner.groupBy(*keys, "axis", "lo", "hi").agg(F.sort_array(F.collect_list("at")).alias("at")))
    for d in range(rank):
        own = lists.filter(F.col("axis") == d).select(*keys, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("at").alias(f"__at{d}"))
        found = boxes.withColumns({"__lo": F.get("offset", d), "__hi": F.get("offset", d) + F.get("extent", d)})
        boxes = found.join(own, [*keys, "__lo", "__hi"], "left").drop("__lo", "__hi")
    return boxes.select(*keys, "offset", "extent", F.array(*(f"__at{d}" for d in range(rank))).alias("at"))


def _cut(blocks: DataFrame, cuts: DataFrame, rank: int, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The blocks cut at the places of cuts (keys, offset, extent, at: an array for each axis): (keys, offset, extent, out), each value once.

    Pieces are sliced inside the arrays, in the generator, so that no piece carries the block it is of.
    """
    found = blocks.filter(F.col(value).isNotNull()).withColumns({c: F.col(c).cast("array<bigint>") for c in ("offset", "extent")}).join(cuts, [*keys, "offset", "extent"])
    pieces = F.array(F.struct(F.array().cast("array<bigint>").alias("o"), F.array().cast("array<bigint>").alias("e")))
    for d in range(rank):
        low, high = F.get("offset", d), F.get("offset", d) + F.get("extent", d)
        inner = F.coalesce(F.get("at", d), F.array().cast("array<bigint>"))
        edges = F.array_distinct(F.concat(F.array(low), inner, F.array(high)))
        spans = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct(a.alias("o"), (b - a).alias("e")))
        pieces = F.flatten(F.transform(pieces, lambda p: F.transform(spans, lambda s: F.struct(F.concat(p["o"], F.array(s["o"])).alias("o"), F.concat(p["e"], F.array(s["e"])).alias("e")))))  # noqa: B023

    def sliced(p: Column) -> Column:
        def place(k: Column) -> Column:
            index: list[Column] = []
            for d in range(rank - 1, -1, -1):
                index.insert(0, F.get(p["o"], d) + k % F.get(p["e"], d))
                k = F.call_function("div", k, F.get(p["e"], d))
            at = F.lit(0).cast("long")
            for d, i in enumerate(index):
                at = at * F.get("extent", d) + (i - F.get("offset", d))
            return F.get(value, at.cast("int"))

        count = F.aggregate(p["e"], F.lit(1).cast("long"), lambda n, e: n * e)
        return F.struct(p["o"].alias("offset"), p["e"].alias("extent"), F.transform(F.sequence(F.lit(0).cast("long"), count - 1), place).alias(out))

    return found.select(*keys, F.inline(F.transform(pieces, sliced)))


def aligned_blocks(components: dict[str, DataFrame], rank: int, keys: Sequence[str] = ("iteration",), value: str = "values") -> DataFrame:
    """(keys, offset, extent, an array for each component) of components that are chunked in other ways, block by block: no row is a cell.

    All are cut at the edges that the chunks of any of them have along an axis, their common refinement, and joined by the offsets of
    the pieces; each value is shuffled twice, to meet the edges inside its block and to meet the other components. Where one component has no value for a
    piece of another, that is an error, as arrays of other lengths are.
    """
    cuts = _edges_inside(components, rank, keys, value)
    out, on = None, [*keys, "offset", "extent"]
    for name, blocks in components.items():
        own = _cut(blocks, cuts, rank, keys, value, name)
        out = own if out is None else out.join(own, on, "full")
    lacking = F.lit(False)
    for name in components:
        lacking = lacking | F.col(name).isNull()
    return out.select(*on, *(F.when(lacking, F.raise_error(F.concat(F.lit("a component has no values at "), F.to_json(F.struct("offset", "extent")))).cast(out.schema[n].dataType)).otherwise(F.col(n)).alias(n) for n in components))


def field_max(cells: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = ("iteration",)) -> DataFrame:
    """The greatest value and its cell, the first of equal ones by the order columns; partial results only are shuffled.

    Null and NaN cells don't count; keys without any other cell have no row.
    """
    known = cells.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    first = F.min_by(F.struct(value, *order), F.struct((-F.col(value)).alias("v"), *order))
    return known.groupBy(*keys).agg(first.alias("__at")).select(*keys, *(F.col(f"__at.{c}").alias(c) for c in (value, *order)))


def with_positions(cells: DataFrame, mesh_meta: DataFrame, rank: int, keys: Sequence[str] = ("iteration",), factor: float = 1.0) -> DataFrame:
    """Cells with x0.. in SI units (times factor), from a small table of grid_spacing, grid_global_offset, grid_unit_si."""
    meta = mesh_meta.select(*keys, F.col("grid_spacing").alias("__s"), F.col("grid_global_offset").alias("__o"), F.coalesce("grid_unit_si", F.lit(1.0)).alias("__u"))
    found = cells.join(meta, list(keys), "left")
    at = lambda d: F.col("__u") * (F.col(f"i{d}") * F.coalesce(F.get("__s", d), F.lit(1.0)) + F.coalesce(F.get("__o", d), F.lit(0.0))) * F.lit(float(factor))
    return found.withColumns({f"x{d}": at(d) for d in range(rank)}).drop("__s", "__o", "__u")


