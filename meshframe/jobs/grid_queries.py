"""Registered queries of fields in three dimensions, of boxes and of series on storage, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from meshframe.functions import attributes as attrs
from meshframe.functions import slicing
from meshframe.jobs import generate
from meshframe.jobs import views as V
from meshframe.jobs.registry import query, scratch
from meshframe.operators import chunks, meshes, patches
from meshframe.sources import components, layout, series, tolerant
from meshframe.streaming import steps

# Slices ---------------------------------------------------------------------------------------------


@query(f"""WITH {V.CELLS_3D}, n AS (SELECT (max(vec_id) // 16 + 1) * 4 n FROM embeddings)
SELECT 0 AS axis, iteration, i0, i1, i2, v AS value, i1 * 16 + i2 AS position FROM e, n WHERE i0 = n // 2
UNION ALL SELECT 1, iteration, i0, i1, i2, v, i0 * 16 + i2 FROM e WHERE i1 = 5
UNION ALL SELECT 2, iteration, i0, i1, i2, v, i0 * 16 + i1 FROM e WHERE i2 = 14""")
def b9_planes_3d(spark, sf_dir):
    """A plane on each axis of a field in three dimensions; inside the blocks, only its cells become rows."""
    shape = (V.length_3d(spark, sf_dir), 16, 16)
    found = []
    for axis, at in ((0, shape[0] // 2), (1, 5), (2, -2)):
        box = slicing.plane(shape, axis, at)
        cells = meshes.load_chunk(meshes.blocks_to_cells(V.blocks_3d(spark, sf_dir), 3, box=box), box)
        found.append(cells.select(F.lit(axis).alias("axis"), "iteration", "i0", "i1", "i2", "value", "position"))
    return reduce(lambda a, b: a.unionByName(b), found)


@query(f"""WITH {V.CELLS_3D}, n AS (SELECT (max(vec_id) // 16 + 1) * 4 n FROM embeddings)
SELECT iteration, i0, i1, i2, v AS value, i0 - 3 j0, i1 - 2 j1, i2 - 7 j2, ((i0 - 3) * 9 + i1 - 2) * 9 + i2 - 7 AS position FROM e, n WHERE i0 >= 3 AND i0 < n - 2 AND i1 BETWEEN 2 AND 10 AND i2 >= 7""")
def b7_b8_slab_3d(spark, sf_dir):
    """A box that begins and ends inside blocks on all three axes."""
    box = slicing.region((slice(3, -2), slice(2, 11), slice(-9, None)), (V.length_3d(spark, sf_dir), 16, 16))
    return meshes.load_chunk(meshes.blocks_to_cells(V.blocks_3d(spark, sf_dir), 3, box=box), box)


@query(f"""WITH {V.CELLS_3D}, n AS (SELECT (max(vec_id) // 16 + 1) * 4 n FROM embeddings)
SELECT 'first' AS place, iteration, i0, i1, i2, v AS value FROM e, n WHERE i0 < n // 3 AND i1 < 5 AND i2 < 5
UNION ALL SELECT 'centre', iteration, i0, i1, i2, v FROM e, n WHERE i0 >= (n - n // 3) // 2 AND i0 < (n - n // 3) // 2 + n // 3 AND i1 BETWEEN 5 AND 9 AND i2 BETWEEN 5 AND 9
UNION ALL SELECT 'last', iteration, i0, i1, i2, v FROM e, n WHERE i0 >= n - n // 3 AND i1 >= 11 AND i2 >= 11""")
def b10_blocks_3d(spark, sf_dir):
    """A third of each axis: at the first corner, in the centre, at the last corner."""
    shape = (V.length_3d(spark, sf_dir), 16, 16)
    parts = [meshes.blocks_to_cells(V.blocks_3d(spark, sf_dir), 3, box=slicing.part(shape, 3, where)).withColumn("place", F.lit(where)) for where in ("first", "centre", "last")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH x AS (SELECT vec_id i0, embedding e, list_reverse(embedding) r, unnest([0, 24, 48]) o1 FROM embeddings)
SELECT i0, o1, CAST(1 AS BIGINT) e0, CASE WHEN o1 = 48 THEN 16 ELSE 24 END e1, CAST(CASE WHEN o1 = 48 THEN 16 ELSE 24 END AS INTEGER) n,
       CAST(e[o1 + 1] AS DOUBLE) * CAST(e[o1 + 1] AS DOUBLE) + CAST(r[o1 + 1] AS DOUBLE) * CAST(r[o1 + 1] AS DOUBLE) AS first,
       CAST(e[o1 + CASE WHEN o1 = 48 THEN 16 ELSE 24 END] AS DOUBLE) * CAST(e[o1 + CASE WHEN o1 = 48 THEN 16 ELSE 24 END] AS DOUBLE) + CAST(r[o1 + CASE WHEN o1 = 48 THEN 16 ELSE 24 END] AS DOUBLE) * CAST(r[o1 + CASE WHEN o1 = 48 THEN 16 ELSE 24 END] AS DOUBLE) AS last FROM x""")
def d1_b16_two_grids(spark, sf_dir):
    """The intensity of two components of one field, of which one has chunks of single rows and the other of two rows and 24 columns."""
    e = V.table(spark, sf_dir, "embeddings")
    zero = F.lit(0).cast("long")
    x = e.select(zero.alias("iteration"), F.array("vec_id", zero).alias("offset"), F.array(F.lit(1).cast("long"), F.lit(64).cast("long")).alias("extent"), F.col("embedding").alias("values"))
    pair = e.groupBy(F.floor(F.col("vec_id") / 2).alias("pair")).agg(F.sort_array(F.collect_list(F.struct("vec_id", F.reverse("embedding").alias("r")))).alias("rows"))
    columns = F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("o"), F.lit(w).cast("long").alias("w")) for o, w in ((0, 24), (24, 24), (48, 16))))).alias("c")
    y = pair.select("pair", "rows", columns).select(
        zero.alias("iteration"), F.array(F.col("rows")[0]["vec_id"], F.col("c.o")).alias("offset"), F.array(F.size("rows").cast("long"), F.col("c.w")).alias("extent"),
        F.flatten(F.transform("rows", lambda r: F.slice(r["r"], (F.col("c.o") + 1).cast("int"), F.col("c.w").cast("int")))).alias("values"),
    )
    found = meshes.aligned_blocks({"x": x, "y": y}, 2).withColumn("i", meshes.block_intensity("x", "y"))
    return found.select(F.get("offset", 0).alias("i0"), F.get("offset", 1).alias("o1"), F.get("extent", 0).alias("e0"), F.get("extent", 1).alias("e1"), F.size("i").alias("n"), F.get("i", 0).alias("first"), F.element_at("i", -1).alias("last"))


# Files and boxes ------------------------------------------------------------------------------------


@query(f"""WITH {V.CELLS_3D}, {V.BLOCKS_3D}, n AS (SELECT (max(vec_id) // 16 + 1) * 4 n FROM embeddings),
f AS (SELECT iteration, o0 // 8 a, o1 // 8 b, o2 // 8 c, min(o0) l0, max(o0) + 4 h0, min(o1) l1, max(o1) + 4 h1, min(o2) l2, max(o2) + 4 h2 FROM b GROUP BY ALL),
q AS (SELECT 0 AS axis, n // 2 AS p FROM n UNION ALL SELECT 1, 5 UNION ALL SELECT 2, 14),
k AS (SELECT axis, count(*) files FROM q JOIN f ON (axis = 0 AND l0 <= p AND p < h0) OR (axis = 1 AND l1 <= p AND p < h1) OR (axis = 2 AND l2 <= p AND p < h2) GROUP BY axis),
s AS (SELECT axis, count(*) cells, min(v) least, max(v) most FROM q JOIN e ON (axis = 0 AND i0 = p) OR (axis = 1 AND i1 = p) OR (axis = 2 AND i2 = p) GROUP BY axis)
SELECT axis, files, (SELECT count(*) FROM f) AS all_files, cells, least, most FROM k JOIN s USING (axis)""")
def a5_d4_files_of_planes(spark, sf_dir):
    """A field laid out along a space-filling curve; the table of boxes picks the files of a plane on each axis, and just these are opened."""
    path, shape = scratch(spark, "laid-out"), (V.length_3d(spark, sf_dir), 16, 16)
    layout.write(V.blocks_3d(spark, sf_dir), path, (4, 4, 4), side=1)
    every, found = layout.boxes(spark, path).count(), []
    for axis, at in ((0, shape[0] // 2), (1, 5), (2, 14)):
        box = slicing.plane(shape, axis, at)
        blocks = layout.read(spark, path, box)
        cells = meshes.blocks_to_cells(blocks, 3, box=box)
        found.append(cells.agg(F.count("*").alias("cells"), F.min("value").alias("least"), F.max("value").alias("most")).select(F.lit(axis).alias("axis"), F.lit(layout.crossing(spark, path, box).count()).cast("long").alias("files"), F.lit(every).alias("all_files"), "*"))
    return reduce(lambda a, b: a.unionByName(b), found)


@query(f"""WITH {V.BLOCKS_3D}, r AS (SELECT p_partkey, p_partkey * 3 % (SELECT max(o0) + 4 FROM b) o0, p_partkey * 7 % 14 o1, p_partkey * 5 % 15 o2, 1 + p_size % 9 e0, 1 + p_partkey % 7 e1, 1 + p_size % 3 e2 FROM part)
SELECT p_partkey, iteration, greatest(r.o0, b.o0) o0, greatest(r.o1, b.o1) o1, greatest(r.o2, b.o2) o2,
       least(r.o0 + e0, b.o0 + 4) - greatest(r.o0, b.o0) e0, least(r.o1 + e1, b.o1 + 4) - greatest(r.o1, b.o1) e1, least(r.o2 + e2, b.o2 + 4) - greatest(r.o2, b.o2) e2
FROM r JOIN b ON r.o0 < b.o0 + 4 AND b.o0 < r.o0 + e0 AND r.o1 < b.o1 + 4 AND b.o1 < r.o1 + e1 AND r.o2 < b.o2 + 4 AND b.o2 < r.o2 + e2""")
def d4_overlap_3d(spark, sf_dir):
    """A requested box for each part, of many shapes, and the chunks of a field in three dimensions."""
    n, k, s = V.length_3d(spark, sf_dir), F.col("p_partkey"), F.col("p_size")
    box = lambda *x: F.array(*(c.cast("long") for c in x))
    want = V.table(spark, sf_dir, "part").select(F.lit("rho").alias("path"), "p_partkey", box(k * 3 % n, k * 7 % 14, k * 5 % 15).alias("offset"), box(1 + s % 9, 1 + k % 7, 1 + s % 3).alias("extent"))
    have = V.blocks_3d(spark, sf_dir).select(F.lit("rho").alias("path"), "offset", "extent", "iteration")
    found = chunks.overlap(want, have, 3)
    return found.select("p_partkey", F.col("c_iteration").alias("iteration"), *(F.get(c, d).alias(f"{c[0]}{d}") for c in ("offset", "extent") for d in range(3)))


@query("""WITH p AS (SELECT year(l_shipdate) iteration, l_orderkey id, l_quantity x, l_discount * 100 y, l_tax * 100 z FROM lineitem),
b AS (SELECT s_suppkey, 1992 + s_suppkey % 7 iteration, s_suppkey * 7 % 45 x, s_suppkey % 9 y, s_suppkey * 3 % 7 z, 2 + s_nationkey % 5 ex, 1 + s_suppkey % 3 ey, 1 + s_suppkey % 4 ez FROM supplier)
SELECT s_suppkey, p.iteration, count(*) n, CAST(sum(id) AS BIGINT) ids FROM p JOIN b ON p.iteration = b.iteration AND p.x >= b.x AND p.x < b.x + ex AND p.y >= b.y AND p.y < b.y + ey AND p.z >= b.z AND p.z < b.z + ez GROUP BY ALL""")
def d3_particles_in_boxes(spark, sf_dir):
    """The particles in the box of each patch, by position in three dimensions."""
    line, k = V.table(spark, sf_dir, "lineitem"), F.col("s_suppkey")
    p = line.select(F.year("l_shipdate").cast("long").alias("iteration"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    own = {"offset_x": k * 7 % 45, "offset_y": k % 9, "offset_z": k * 3 % 7, "extent_x": 2 + F.col("s_nationkey") % 5, "extent_y": 1 + k % 3, "extent_z": 1 + k % 4}
    boxes = V.table(spark, sf_dir, "supplier").select("s_suppkey", (1992 + k % 7).cast("long").alias("iteration"), *(c.cast("double").alias(n) for n, c in own.items()))
    found = patches.totals_at_position(p, boxes, ["x", "y", "z"], ["x", "y", "z"], {"ids": "id"}, ["iteration"])
    return found.groupBy("s_suppkey", "iteration").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


@query("""WITH c AS (SELECT DISTINCT p_brand path, p_partkey // 20 i0, p_partkey % 20 i1 FROM part WHERE p_size > 10),
x AS (SELECT path, i0, min(i1) o1, count(*) e1 FROM (SELECT *, i1 - row_number() OVER (PARTITION BY path, i0 ORDER BY i1) r FROM c) GROUP BY path, i0, r)
SELECT path, min(i0) o0, o1, count(*) e0, e1 FROM (SELECT *, i0 - row_number() OVER (PARTITION BY path, o1, e1 ORDER BY i0) r FROM x) GROUP BY path, o1, e1, r""")
def f2_boxes_2d(spark, sf_dir):
    """The boxes of the written cells of each brand."""
    part = V.table(spark, sf_dir, "part").filter("p_size > 10")
    boxes = chunks.written_chunks(part.select(F.col("p_brand").alias("path"), F.floor(F.col("p_partkey") / 20).alias("i0"), (F.col("p_partkey") % 20).alias("i1")), 2)
    return boxes.select("path", *(F.get(c, d).alias(f"{c[0]}{d}") for c in ("offset", "extent") for d in range(2)))


@query("""WITH c AS (SELECT DISTINCT p_size % 2 path, p_partkey // 36 i0, p_partkey // 6 % 6 i1, p_partkey % 6 i2 FROM part WHERE p_size > 4),
x AS (SELECT path, i0, i1, min(i2) o2, count(*) e2 FROM (SELECT *, i2 - row_number() OVER (PARTITION BY path, i0, i1 ORDER BY i2) r FROM c) GROUP BY path, i0, i1, r),
y AS (SELECT path, i0, min(i1) o1, count(*) e1, o2, e2 FROM (SELECT *, i1 - row_number() OVER (PARTITION BY path, i0, o2, e2 ORDER BY i1) r FROM x) GROUP BY path, i0, o2, e2, r)
SELECT path, min(i0) o0, o1, o2, count(*) e0, e1, e2 FROM (SELECT *, i0 - row_number() OVER (PARTITION BY path, o1, e1, o2, e2 ORDER BY i0) r FROM y) GROUP BY path, o1, e1, o2, e2, r""")
def f2_boxes_3d(spark, sf_dir):
    """The boxes of written cells in three dimensions."""
    part, k = V.table(spark, sf_dir, "part").filter("p_size > 4"), F.col("p_partkey")
    cells = part.select((F.col("p_size") % 2).alias("path"), F.floor(k / 36).alias("i0"), (F.floor(k / 6) % 6).alias("i1"), (k % 6).alias("i2"))
    boxes = chunks.written_chunks(cells, 3)
    return boxes.select("path", *(F.get(c, d).alias(f"{c[0]}{d}") for c in ("offset", "extent") for d in range(3)))


# Made series ------------------------------------------------------------------------------------------


def _extents(spark, sf_dir):
    """Blocks as large as the sizes of parts, one for each part."""
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block"), F.col("p_size").cast("long").alias("cells"))


@query("""SELECT CAST(s AS BIGINT) iteration, p_partkey block, CAST(p_size AS BIGINT) cells, p_partkey + 0.01::DOUBLE * s first, p_partkey + 0.01::DOUBLE * s + (p_size - 1) * 0.0001::DOUBLE AS last FROM part, (SELECT unnest(range(2)) s) WHERE p_size > 0""")
def k1_fields_of_extents(spark, sf_dir):
    """A made field with a block for each part, as large as its size."""
    made = generate.fields_of(_extents(spark, sf_dir), 2)
    return made.groupBy("iteration", "block").agg(F.count("*").alias("cells"), F.min("rho").alias("first"), F.max("rho").alias("last"))


@query("""WITH e AS (SELECT p_partkey block, p_size n, CAST(sum(p_size) OVER (ORDER BY p_partkey) AS BIGINT) - p_size before FROM part)
SELECT CAST(s AS BIGINT) iteration, block, before AS first, before + n - 1 AS last, 0.1::DOUBLE * s + 0.0001::DOUBLE * (n - 1) charge, 1.0::DOUBLE * s + 0.0002::DOUBLE * (n - 1) position_x FROM e, (SELECT unnest(range(2)) s) WHERE n > 0""")
def k2_particles_of_extents(spark, sf_dir):
    """Made particles, as many of each part as its size, numbered through all parts."""
    made = generate.particles_of(_extents(spark, sf_dir), 2)
    return made.groupBy("iteration", "block").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.max("charge").alias("charge"), F.max("position_x").alias("position_x"))


@query("SELECT p_partkey block, CAST(p_size AS BIGINT) cells, CAST(p_size AS BIGINT) places, true AS inside FROM part WHERE p_size > 0")
def k4_random_of_extents(spark, sf_dir):
    """Random cells of a block for each part: all places, values in their range, and the same when they are made again."""
    extents = _extents(spark, sf_dir)
    # Spark's guess of the made cells is the file of their extents: it would broadcast them, or sort them in few tasks
    parts = (extents.agg(F.sum("cells")).first()[0] or 0) // 500_000 + 1
    made, again = (generate.random_integers_of(extents).repartition(parts, "block", "i") for _ in range(2))
    both = made.join(again.withColumnRenamed("value", "same").hint("merge"), ["block", "i"])
    return both.groupBy("block").agg(F.count("*").alias("cells"), F.count_distinct("i").alias("places"), F.bool_and(F.col("value").between(0, 200_000_000) & (F.col("value") == F.col("same"))).alias("inside"))


# Attributes -------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN -128 AND 127 THEN p_size END AS narrow, CASE WHEN p_partkey * 100 <= 65535 THEN p_partkey * 100 ELSE -1 END AS wider, p_size % 5 != 0 AS truth,
chr(CAST(65 + p_size % 26 AS INTEGER)) AS letter, CAST(p_size AS DOUBLE) re, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS DOUBLE) ELSE 0.0 END im, [p_size % 2 = 1, false] AS flags FROM part""")
def c2_further_types(spark, sf_dir):
    """Narrow integers, truth values, characters, complex numbers and lists of truth values."""
    k, s, to = F.col("p_partkey"), F.col("p_size"), attrs.converted
    text = lambda c: c.cast("string")
    number = F.when(k % 2 == 0, F.format_string("[%d.0, %d.0]", s.cast("long"), k.cast("long"))).otherwise(text(s))
    z = to(number, F.when(k % 2 == 0, "CDOUBLE").otherwise("INT"), "complex")
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", to(text(s), F.lit("INT"), "byte").alias("narrow"), F.coalesce(to(text(k * 100), F.lit("LONG"), "ushort"), F.lit(-1).cast("long")).alias("wider"), to(text(s % 5), F.lit("UINT"), "bool").alias("truth"),
        to(text(65 + s % 26), F.lit("UCHAR"), "char").alias("letter"), z["re"].alias("re"), z["im"].alias("im"), to(F.format_string("[%d, 0]", (s % 2).cast("long")), F.lit("VEC_INT"), "bool_array").alias("flags"),
    )


@query("""WITH n AS (SELECT p_partkey iteration, '/particles/e' AS path, 'species' node_type, ['position', 'positionOffset'] w FROM part UNION ALL SELECT p_partkey, '/particles/e/patches', 'patches', ['numParticles', 'numParticlesOffset', 'offset', 'extent'] FROM part WHERE p_size % 2 = 0),
w AS (SELECT iteration, path, node_type, unnest(w) AS name FROM n)
SELECT w.* FROM w JOIN part ON iteration = p_partkey WHERE NOT ((node_type = 'species' AND (name = 'position' OR p_size % 3 = 0)) OR (node_type = 'patches' AND (name IN ('numParticles', 'offset') OR p_size % 4 = 0)))""")
def a8_required_records(spark, sf_dir):
    """Records that species and their patches lack."""
    part = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("iteration"), "p_size")
    node = lambda path, kind: F.struct(F.lit(path).alias("path"), F.lit(kind).alias("node_type"))
    have = [F.array(node("/particles/e", "species"), node("/particles/e/position", "record")), F.when(F.col("p_size") % 3 == 0, F.array(node("/particles/e/positionOffset", "record")))]
    own = [node(f"/particles/e/patches/{n}", "record") for n in ("numParticles", "offset")]
    have.append(F.when(F.col("p_size") % 2 == 0, F.array(node("/particles/e/patches", "patches"), *own)))
    have.append(F.when(F.col("p_size") % 4 == 0, F.array(*(node(f"/particles/e/patches/{n}", "record") for n in ("numParticlesOffset", "extent")))))
    nodes = part.select("iteration", F.explode(F.flatten(F.filter(F.array(*have), lambda x: x.isNotNull()))).alias("n")).select("iteration", "n.*")
    return attrs.missing_children(nodes)


# Steps ----------------------------------------------------------------------------------------------


@query(f"""WITH {V.LOG}, d AS (SELECT series, iteration, min(write_seq) write_seq, count(*) - 1 reopened FROM g GROUP BY ALL),
s AS (SELECT series, count(DISTINCT r) intervals FROM (SELECT series, iteration - row_number() OVER (PARTITION BY series ORDER BY iteration) r FROM d) GROUP BY series)
SELECT series, iteration, write_seq, reopened, intervals FROM d JOIN s USING (series)""")
def i2_i3_closed_steps(spark, sf_dir):
    """The log as a stream of four batches: each iteration of a series written once, steps that open it again put aside, and the intervals of closed ones, which are all the state."""
    source, out, check = (scratch(spark, n) for n in ("growing", "closed-steps", "closed-check"))
    log = V.log(spark, sf_dir).select("series", "iteration", "write_seq")
    lo, hi = log.agg(F.min("write_seq"), F.max("write_seq")).first()
    for k in range(4):  # a folder for each quarter of the log, one after another, and as many files as Spark makes of it
        own = log.filter(F.floor((F.col("write_seq") - lo) * 4 / (hi - lo + 1)) == k)
        own.write.parquet(f"{source}/{k}")
        stream = steps.read_steps(spark, f"{source}/*", log.schema, 1 << 20)
        steps.closed_capture(stream, out, check).awaitTermination()
    kind = "series string, iteration long, write_seq long"
    read = lambda name: spark.read.schema(kind).parquet(f"{out}/{name}").select("series", "iteration", "write_seq")
    again = read("reopened").groupBy("series", "iteration").agg(F.count("*").alias("reopened"))
    spans = steps.closed_iterations(spark, out, "series string, lo long, hi long").groupBy("series").agg(F.count("*").alias("intervals"))
    found = read("steps").join(again, ["series", "iteration"], "left").join(spans, "series")
    return found.select("series", "iteration", "write_seq", F.coalesce("reopened", F.lit(0).cast("long")).alias("reopened"), "intervals")


# Storage --------------------------------------------------------------------------------------------


@query("""SELECT CAST(label AS BIGINT) iteration, vec_id AS "row", CASE WHEN label = 3 THEN -1.0 ELSE CAST(embedding[1] AS DOUBLE) END x,
CASE WHEN vec_id % 5 = 0 AND label < 4 THEN 2.0 ELSE CAST(embedding[2] AS DOUBLE) END y, label < 4 AS compacted FROM embeddings
UNION ALL SELECT CAST(label AS BIGINT) + 100, vec_id, 7.0, NULL, FALSE FROM embeddings WHERE label = 0""")
def a12_component_log(spark, sf_dir):
    """Components of stored iterations overwritten, whole and in part, an iteration added, and the component that was written again compacted."""
    path = scratch(spark, "component-log")
    v = V.vectors(spark, sf_dir).withColumnRenamed("i0", "row")
    value = lambda c: F.col(c).alias("value")
    components.write(v.select("iteration", "row", value("x")), path, "x", 0, whole=True)
    components.write(v.select("iteration", "row", value("y")), path, "y", 0, whole=True)
    components.write(v.filter("iteration = 3").select("iteration", "row", F.lit(-1.0).alias("value")), path, "x", 1, whole=True)
    components.write(v.filter("iteration = 0").select((F.col("iteration") + 100).alias("iteration"), "row", F.lit(7.0).alias("value")), path, "x", 2, whole=True)
    components.write(v.filter("row % 5 = 0 and iteration < 4").select("iteration", "row", F.lit(2.0).alias("value")), path, "y", 1, whole=False)
    done = components.compacted(spark, path, "y")
    return components.read_together(spark, path, ["x", "y"]).select("iteration", "row", "x", "y", F.col("iteration").isin(*done).alias("compacted"))


@query("""SELECT CAST(label AS BIGINT) iteration, count(*) n, CAST(sum(vec_id) AS BIGINT) ids, 0 AS bad FROM embeddings GROUP BY label
UNION ALL SELECT 1000 + k, 0, 0, 1 FROM (SELECT unnest(range(2)) k)""")
def a7_columnar_errors(spark, sf_dir):
    """A columnar series in which two iterations have a file that can't be read: their siblings are read, and they are reported."""
    path = scratch(spark, "damaged")
    series.write(V.vectors(spark, sf_dir).select("iteration", "i0", "x"), path, "fileBased")
    for k in range(2):
        spark.range(k, k + 1).selectExpr("repeat('no such format ', 50) value").write.text(f"{path}/iteration={1000 + k}")
    good, bad = tolerant.read(spark, path)
    rows = good.groupBy("iteration").agg(F.count("*").alias("n"), F.sum("i0").alias("ids")).withColumn("bad", F.lit(0))
    zero = F.lit(0).cast("long")
    return rows.unionByName(bad.groupBy("iteration").agg(zero.alias("n"), zero.alias("ids"), F.count("*").cast("int").alias("bad")))


@query("""WITH n AS (SELECT max(s_suppkey) + 1 n FROM supplier), g AS (SELECT unnest(range(n + 2)) i0 FROM n)
SELECT 'constant' AS kind, i0, i1, 2.5 AS value FROM g, (SELECT unnest(range(4)) i1)
UNION ALL SELECT 'empty', i0, i1, 1.5 FROM g, (SELECT unnest(range(4)) i1)
UNION ALL SELECT 'array', s_suppkey, i1, s_acctbal FROM supplier, (SELECT unnest(range(3)) i1)""")
def h3_grown(spark, sf_dir):
    """Components grown along both axes: a constant one and an empty one that becomes constant are filled, an array's new places stay unwritten."""
    s = V.table(spark, sf_dir, "supplier")
    n = s.agg(F.max("s_suppkey")).first()[0] + 1
    cells = s.select(F.col("s_suppkey").cast("long").alias("i0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("i1"), F.col("s_acctbal").cast("double").alias("value"))
    grown = {
        "constant": chunks.extend(cells.withColumn("value", F.lit(2.5)), [n, 3], [n + 2, 4], "constant", fill=2.5),
        "empty": chunks.extend(cells.limit(0), [0, 0], [n + 2, 4], "empty", "constant", 1.5),
        "array": chunks.extend(cells, [n, 3], [n + 2, 4]),
    }
    return reduce(lambda a, b: a.unionByName(b), (df.select(F.lit(k).alias("kind"), "i0", "i1", "value") for k, df in grown.items()))
