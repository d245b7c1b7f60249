"""The registered queries over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshframe.functions import attributes as attrs
from meshframe.functions import dtypes, slicing, units
from meshframe.jobs import generate
from meshframe.jobs import views as V
from meshframe.jobs.registry import ORACLE, QUERIES, query, scratch  # noqa: F401
from meshframe.operators import chunks, histograms, meshes, particles, patches, replay, summary
from meshframe.operators.numbering import numbered
from meshframe.sources import documents, files, series
from meshframe.streaming import steps

# Species ------------------------------------------------------------------------------------------


@query(f"""WITH {V.PARTICLES}, h AS (SELECT iteration, species, CAST(least(floor((momentum_z - 0.0) / (110000.0 / 50)), 49) AS INTEGER) bin, CAST(sum(CAST(weighting AS DECIMAL(18,6))) AS DOUBLE) w FROM p WHERE momentum_z BETWEEN 0 AND 110000 GROUP BY ALL)
SELECT k.iteration, k.species, CAST(b.bin AS INTEGER) bin, coalesce(w, 0.0) weight FROM (SELECT DISTINCT iteration, species FROM h) k CROSS JOIN (SELECT unnest(range(50)) bin) b LEFT JOIN h USING (iteration, species, bin)""")
def e3_weighted_histogram(spark, sf_dir):
    return histograms.histogram(V.particles(spark, sf_dir), "momentum_z", 50, 0.0, 110000.0, F.col("weighting"), ("iteration", "species"), exact=True)


@query(f"""WITH {V.PARTICLES}, r AS (SELECT min(position_z) lo, max(position_z) hi FROM p),
h AS (SELECT species, CAST(least(floor((position_z - lo) / ((hi - lo) / 80)), 79) AS INTEGER) bin_x, CAST(least(floor(momentum_z / (110000.0 / 80)), 79) AS INTEGER) bin_y, CAST(sum(CAST(weighting AS DECIMAL(18,6))) AS DOUBLE) w FROM p, r WHERE momentum_z BETWEEN 0 AND 110000 GROUP BY ALL)
SELECT species, CAST(x AS INTEGER) bin_x, CAST(y AS INTEGER) bin_y, coalesce(w, 0.0) weight FROM (SELECT DISTINCT species FROM h) CROSS JOIN (SELECT unnest(range(80)) x) CROSS JOIN (SELECT unnest(range(80)) y) LEFT JOIN h USING (species) WHERE FALSE
UNION ALL SELECT k.species, CAST(x AS INTEGER), CAST(y AS INTEGER), coalesce(w, 0.0) FROM (SELECT DISTINCT species FROM h) k CROSS JOIN (SELECT unnest(range(80)) x) CROSS JOIN (SELECT unnest(range(80)) y) LEFT JOIN h ON h.species = k.species AND h.bin_x = x AND h.bin_y = y""")
def e4_phase_space(spark, sf_dir):
    p = V.particles(spark, sf_dir)
    return histograms.histogram_2d(p, ("position_z", None, None, 80), ("momentum_z", 0.0, 110000.0, 80), F.col("weighting"), ("species",), exact=True)


@query(f"WITH {V.PARTICLES} SELECT iteration, species, count(*) n, CAST(sum(CAST(momentum_z AS DECIMAL(18,2))) AS DOUBLE) / count(*) momentum_z_mean, min(position_z) position_z_min, max(position_z) position_z_max FROM p GROUP BY ALL")
def e1_e2_column_stats(spark, sf_dir):
    p = V.particles(spark, sf_dir)
    stats = particles.column_stats(p, ["position_z"], ["iteration", "species"]).drop("position_z_mean")
    mean = p.groupBy("iteration", "species").agg((F.sum(F.col("momentum_z").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("momentum_z_mean"))
    return stats.join(mean, ["iteration", "species"])


@query("SELECT l_orderkey id, l_quantity * 1e-6 position_z, l_extendedprice momentum_z, CAST(l_linenumber AS DOUBLE) * 0.5 level, l_discount weighting, 9.10938291e-31::DOUBLE mass FROM lineitem")
def b1_b2_b13_to_df(spark, sf_dir):
    lineitem = V.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    records = {("position", "z"): "l_quantity", ("momentum", "z"): "l_extendedprice", ("level", None): "l_linenumber", ("weighting", None): "l_discount"}
    scale = {("position", "z"): 1e-6, ("momentum", "z"): 1.0 + 1e-12, ("level", None): 0.5}
    return particles.to_df(lineitem, records, scale, {("mass", None): 9.10938291e-31}, keep=("id",))


@query(f'WITH {V.PARTICLES} SELECT iteration, species, "row", id, position_z FROM p WHERE "row" >= 10 AND "row" < 110 AND iteration IN (1995, 1996)')
def b3_b4_row_range(spark, sf_dir):
    p = V.numbered_particles(spark, sf_dir, 1995, 1996)
    return particles.rows_between(particles.iterations(p, 1995, 1996), 10, 110).select("iteration", "species", "row", "id", "position_z")


@query(f'WITH {V.PARTICLES}, n AS (SELECT *, count(*) OVER (PARTITION BY iteration, species) n FROM p) SELECT iteration, species, "row", id FROM n WHERE "row" < n // 40')
def b12_particle_blob(spark, sf_dir):
    """Of four readers the first one's tenth of the rows of each species."""
    p = V.numbered_particles(spark, sf_dir)
    total = p.groupBy("iteration", "species").agg(F.count("*").alias("n"))
    return p.join(total, ["iteration", "species"]).filter("row < n div 40").select("iteration", "species", "row", "id")


@query("SELECT l_orderkey, l_extendedprice momentum_z FROM lineitem WHERE l_extendedprice > 90000 AND l_returnflag = 'A'")
def a15_b5_b6_sql_predicate(spark, sf_dir):
    return series.sql(V.table(spark, sf_dir, "lineitem"), "electrons", "SELECT l_orderkey, l_extendedprice AS momentum_z FROM electrons WHERE l_extendedprice > 90000 AND l_returnflag = 'A'")


@query("""SELECT iteration, species, momentum_z, value, CAST(count(*) AS BIGINT) n FROM (SELECT year(l_shipdate) iteration, l_returnflag species, l_extendedprice momentum_z, NULL::DOUBLE AS value FROM lineitem
UNION ALL SELECT year(ts), event_type, NULL, value FROM events) GROUP BY ALL""")
def h1_union_iterations(spark, sf_dir):
    a = V.particles(spark, sf_dir).select("iteration", "species", "momentum_z")
    b = V.table(spark, sf_dir, "events").select(F.year("ts").cast("long").alias("iteration"), F.col("event_type").alias("species"), "value")
    return particles.union_iterations([a, b]).groupBy("iteration", "species", "momentum_z", "value").agg(F.count("*").alias("n"))


@query('SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 "row" FROM events')
def f7_row_numbers(spark, sf_dir):
    return numbered(V.table(spark, sf_dir, "events").select("event_id", "event_type"), [], ["event_id"])


@query("SELECT CAST(label AS BIGINT) iteration, vec_id i0, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z FROM embeddings")
def d1_align_components(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    return particles.align({c: v.select("iteration", "i0", F.col(c).alias("value")) for c in "xyz"}, ["iteration", "i0"])


# Fields -------------------------------------------------------------------------------------------


@query("SELECT CAST(label AS BIGINT) iteration, vec_id i0, CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) * CAST(embedding[2] AS DOUBLE) + CAST(embedding[3] AS DOUBLE) * CAST(embedding[3] AS DOUBLE) intensity FROM embeddings")
def b16_intensity(spark, sf_dir):
    return V.vectors(spark, sf_dir).select("iteration", "i0", meshes.intensity("x", "y", "z").alias("intensity"))


@query("""WITH i AS (SELECT CAST(label AS BIGINT) iteration, vec_id i0, CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) * CAST(embedding[2] AS DOUBLE) + CAST(embedding[3] AS DOUBLE) * CAST(embedding[3] AS DOUBLE) intensity FROM embeddings)
SELECT iteration, intensity, i0, CAST(0.001 AS DOUBLE) * (i0 * CAST(0.5 AS DOUBLE) + CAST(2.0 AS DOUBLE)) * CAST(1000000.0 AS DOUBLE) x0 FROM (SELECT *, row_number() OVER (PARTITION BY iteration ORDER BY intensity DESC, i0) k FROM i) WHERE k = 1""")
def e5_d6_b17_field_maximum(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    best = meshes.field_max(v.select("iteration", "i0", meshes.intensity("x", "y", "z").alias("intensity")), "intensity", ["i0"])
    meta = v.select("iteration").distinct().select("iteration", F.array(F.lit(0.5)).alias("grid_spacing"), F.array(F.lit(2.0)).alias("grid_global_offset"), F.lit(0.001).alias("grid_unit_si"))
    return meshes.with_positions(best, meta, 1, factor=1e6)


@query(f"WITH {V.CELLS} SELECT iteration, i0, i1, v AS value FROM e WHERE i0 BETWEEN 10 AND 209 AND i1 BETWEEN 4 AND 11")
def blocks_to_cells(spark, sf_dir):
    """The cells of a box; blocks outside it aren't unfolded (blocks_unfolded has all cells)."""
    cells = meshes.blocks_to_cells(V.blocks(spark, sf_dir), 2, box=slicing.Region((10, 4), (200, 8)))
    return cells


@query(f"WITH {V.CELLS} SELECT iteration, i0, i1, v AS value, i0 - 5 j0, i1 - 61 j1, (i0 - 5) * 3 + (i1 - 61) position FROM e WHERE i0 >= 5 AND i0 < 105 AND i1 >= 61")
def b7_b8_slice(spark, sf_dir):
    n = V.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    box = slicing.region((slice(5, 105), slice(-3, None)), (n, 64))
    return meshes.load_chunk(meshes.blocks_to_cells(V.blocks(spark, sf_dir), 2, box=box), box)


@query(f"WITH {V.CELLS} SELECT iteration, i0, i1, v AS value, i0 j0, i0 position FROM e WHERE i1 = 7")
def b9_plane(spark, sf_dir):
    n = V.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    box = slicing.plane((n, 64), 1, 7)
    return meshes.load_chunk(meshes.blocks_to_cells(V.blocks(spark, sf_dir), 2, box=box), box)


@query(f"WITH {V.CELLS}, n AS (SELECT max(vec_id) + 1 n FROM embeddings) SELECT count(*) cells, CAST(min(i0) AS BIGINT) first0, CAST(max(i1) AS BIGINT) last1 FROM e, n WHERE i0 >= (n - n // 4) // 2 AND i0 < (n - n // 4) // 2 + n // 4 AND i1 >= 24 AND i1 < 40")
def b10_centre_block(spark, sf_dir):
    n = V.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    cells = meshes.blocks_to_cells(V.blocks(spark, sf_dir), 2, box=slicing.part((n, 64), 4, "centre"))
    return cells.agg(F.count("*").alias("cells"), F.min("i0").alias("first0"), F.max("i1").alias("last1"))


@query(f"WITH {V.CELLS}, n AS (SELECT max(vec_id) + 1 n FROM embeddings) SELECT CAST((i0 // (n // 2)) * 8 + i1 // 8 AS BIGINT) block_id, count(*) cells, min(v) least, max(v) most FROM e, n GROUP BY 1")
def b11_full_scan(spark, sf_dir):
    n = V.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    cells = meshes.blocks_to_cells(V.blocks(spark, sf_dir), 2)
    return cells.groupBy(meshes.grid_block((n, 64), (2, 8)).alias("block_id")).agg(F.count("*").alias("cells"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT vec_id i0, CAST(k * 16 AS BIGINT) o1, CAST((SELECT sum(CAST(x AS DECIMAL(18,8))) FROM (SELECT unnest(embedding[k * 16 + 1:k * 16 + 16]) x)) AS DOUBLE) total, embedding[k * 16 + 1] AS first FROM embeddings, (SELECT unnest(range(4)) k)")
def b19_rechunk(spark, sf_dir):
    """Rows of the field cut in four along axis 1; axis 0 by single rows."""
    n = V.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    cells = meshes.blocks_to_cells(V.blocks(spark, sf_dir), 2)
    cut = meshes.cells_to_blocks(cells, (1, 16), (n, 64))
    total = F.aggregate("values", F.lit(0).cast("decimal(28,8)"), lambda s, x: (s + x.cast("decimal(18,8)")).cast("decimal(28,8)")).cast("double")
    return cut.select(F.get("offset", 0).alias("i0"), F.get("offset", 1).alias("o1"), total.alias("total"), F.get("values", 0).alias("first"))


@query("SELECT vec_id, CAST((label + 1) // 2 AS INTEGER) mode, CAST(2 AS INTEGER) modes FROM embeddings WHERE label IN (1, 2)")
def b15_mode_fields(spark, sf_dir):
    """Labels as fields of axis 0: those of mode 1."""
    first, n = slicing.mode_fields(1)
    e = V.table(spark, sf_dir, "embeddings").filter((F.col("label") >= first) & (F.col("label") < first + n))
    return e.select("vec_id", meshes.azimuthal_mode("label").alias("mode"), meshes.mode_count(F.lit("m=2;imag=+")).alias("modes"))


@query("SELECT o_orderkey iteration, coalesce(o_totalprice, 0.0) * 1e-15 time_si, 1.0 * 1e-15 dt_si, coalesce(o_totalprice, 0.0) * 1e-15 + 0.25 record_time FROM orders")
def b18_seconds(spark, sf_dir):
    its = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("iteration"), F.col("o_totalprice").alias("time"), F.lit(None).cast("double").alias("dt"), F.lit(1e-15).alias("time_unit_si"))
    found = units.iteration_seconds(its)
    return found.select("iteration", "time_si", "dt_si", units.record_time(F.col("time_si"), F.lit(0.25)).alias("record_time"))


# Attributes ---------------------------------------------------------------------------------------


@query("SELECT event_id iteration, '/' || event_type path, json_extract_string(props, '$.k') k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def c1_attributes_wide(spark, sf_dir):
    return attrs.wide(V.attributes(spark, sf_dir), ["k"])


@query("SELECT event_id iteration, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) as_double, [TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)] as_array, CAST(NULL AS DOUBLE[]) as_seven FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def c2_attribute_conversion(spark, sf_dir):
    a = V.attributes(spark, sf_dir)
    to = lambda t: attrs.converted(F.col("value"), F.col("dtype"), t)
    return a.select("iteration", to("double").alias("as_double"), to("array").alias("as_array"), to("array7").alias("as_seven"))


@query("""SELECT iteration, path, name, value FROM (SELECT event_id iteration, '/' || event_type path, 'k' AS name, CASE WHEN event_id % 10 = 0 THEN '7' ELSE json_extract_string(props, '$.k') END AS value FROM events)
WHERE value IS NOT NULL AND NOT (iteration % 10 = 3)""")
def c3_attribute_changes(spark, sf_dir):
    a = V.attributes(spark, sf_dir)
    new = a.filter("iteration % 10 = 0").withColumn("value", F.lit("7"))
    return attrs.deleted(attrs.upserted(a, new), a.filter("iteration % 10 = 3")).select("iteration", "path", "name", "value")


@query("SELECT p_partkey, p_type AS name, node_type FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'series' ELSE 'constant' END node_type FROM part) WHERE NOT (node_type = 'constant' AND p_size = 1)")
def c4_copied_attributes(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("type"), F.when(F.col("p_size") % 2 == 0, "series").otherwise("constant").alias("node_type"), F.when(F.col("p_size") == 1, "shape").otherwise(F.col("p_type")).alias("name"))
    return attrs.copied(part, None).select("p_partkey", F.col("type").alias("name"), "node_type")


@query("SELECT p_partkey, [CAST(p_size AS DOUBLE), 2.0, 0.0, 0.0, 0.0, 0.0, 0.0] powers, p_type = 'cartesian' OR p_type LIKE 'other:%' known, CASE WHEN p_type = 'cartesian' OR p_type LIKE 'other:%' THEN p_type ELSE 'other:' || p_type END geometry, 'other' kind FROM part")
def c5_c6_dimension_geometry(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    base = F.array(*(F.lit(float(x)) for x in (1, 2, 0, 0, 0, 0, 0)))
    powers = F.create_map(F.lit("L"), F.col("p_size").cast("double"))
    return part.select("p_partkey", attrs.unit_dimension(base, powers).alias("powers"), (attrs.geometry_string(F.col("p_type")) == F.col("p_type")).alias("known"), attrs.geometry_string(F.col("p_type")).alias("geometry"), attrs.geometry_kind(F.col("p_type")).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '1.0' END unitSI, coalesce(NULLIF('\"' || p_brand || '\"', '\"Brand#11\"'), '\"cartesian\"') geometry FROM part")
def c7_defaults(spark, sf_dir):
    brand = F.concat(F.lit('"'), "p_brand", F.lit('"'))
    nodes = V.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("unitSI"), F.when(brand != '"Brand#11"', brand).alias("geometry"))
    return attrs.with_defaults(nodes, ["unitSI", "geometry"])


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE year(l_shipdate) NOT IN (1996, 1997)")
def c8_deleted(spark, sf_dir):
    p = V.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("iteration"), "l_orderkey", "l_quantity", "l_tax")
    return series.without(p, [1996, 1997], ["l_tax", "iteration"])


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'LONG' WHEN 1 THEN 'VEC_FLOAT' WHEN 2 THEN 'UINT' ELSE 'STRING' END a, CASE n_nationkey % 4 WHEN 0 THEN 'LONGLONG' WHEN 1 THEN 'FLOAT' WHEN 2 THEN 'INT' ELSE 'STRING' END b, n_nationkey % 4 IN (0, 3) same_kind FROM nation")
def c9_same_kind(spark, sf_dir):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), F.col("n_nationkey").cast("int") % 4 + 1)
    pairs = V.table(spark, sf_dir, "nation").select("n_nationkey", pick("LONG", "VEC_FLOAT", "UINT", "STRING").alias("a"), pick("LONGLONG", "FLOAT", "INT", "STRING").alias("b"))
    return dtypes.same_kind_column(pairs, "a", "b").select("n_nationkey", "a", "b", "same_kind")


@query("SELECT event_id iteration, '/' || event_type path, 'unitSI' AS name, 'missing' problem FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def a8_violations(spark, sf_dir):
    return attrs.violations(V.attributes(spark, sf_dir), {"k": "double", "unitSI": "double"})


# Chunks and patches -------------------------------------------------------------------------------


@query(f"""WITH {V.PARTICLES}, {V.PATCHES} SELECT p.iteration, p.species, "row", id, patch_id FROM p JOIN q ON p.iteration = q.iteration AND p.species = q.species AND "row" >= num_particles_offset AND "row" < num_particles_offset + num_particles""")
def d2_patch_particles(spark, sf_dir):
    found = patches.in_patch(V.numbered_particles(spark, sf_dir), V.patches(spark, sf_dir), width=1024)
    return found.select("iteration", "species", "row", "id", "patch_id")


@query(f"""WITH {V.PARTICLES}, {V.PATCHES} SELECT p.iteration, p.species, "row", patch_id FROM p JOIN q ON p.iteration = q.iteration AND p.species = q.species AND "row" >= num_particles_offset AND "row" < num_particles_offset + num_particles WHERE NOT (position_z >= 0 AND position_z < 45)""")
def d3_patch_violators(spark, sf_dir):
    boxes = V.patches(spark, sf_dir).withColumns({"offset_z": F.lit(0.0), "extent_z": F.lit(45.0)})
    return patches.violators(V.numbered_particles(spark, sf_dir), boxes, ["position_z"], ["z"], width=1024).select("iteration", "species", "row", "patch_id")


@query(f"WITH {V.PARTICLES}, {V.PATCHES} SELECT iteration, species, count(*) num_patches, CAST(sum(num_particles) AS BIGINT) num_particles FROM q GROUP BY ALL")
def e8_patch_counts(spark, sf_dir):
    return patches.patch_counts(V.patches(spark, sf_dir))


@query("""WITH c AS (SELECT p_brand path, p_partkey * 4 o, CAST(p_size AS BIGINT) e FROM part), r AS (SELECT p_brand path, p_partkey * 4 - 6 o, 20 e FROM part)
SELECT c.path, r.o r0, c.o c0, greatest(r.o, c.o) o0, least(r.o + r.e, c.o + c.e) - greatest(r.o, c.o) e0 FROM r JOIN c ON r.path = c.path AND r.o < c.o + c.e AND c.o < r.o + r.e""")
def d4_overlap(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    one = lambda x: F.array(x.cast("long"))
    have = part.select(F.col("p_brand").alias("path"), one(F.col("p_partkey") * 4).alias("offset"), one(F.col("p_size")).alias("extent"))
    want = part.select(F.col("p_brand").alias("path"), one(F.col("p_partkey") * 4 - 6).alias("offset"), one(F.lit(20)).alias("extent"))
    return chunks.overlap(want, have, 1).select("path", F.get("r_offset", 0).alias("r0"), F.get("c_offset", 0).alias("c0"), F.get("offset", 0).alias("o0"), F.get("extent", 0).alias("e0"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_nationkey END source_id, n_name host FROM supplier LEFT JOIN nation ON n_nationkey = CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_nationkey END")
def d5_provenance(spark, sf_dir):
    c = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.lit(-1)).otherwise(F.col("s_nationkey")).alias("source_id"))
    ranks = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), chunks.rank_host(F.concat("n_name", F.lit("\0"))).alias("host"))
    return chunks.provenance(c, ranks).select("s_suppkey", "source_id", "host")


@query("""WITH o AS (SELECT DISTINCT p_brand path, CAST(p_partkey // 3 * 3 AS BIGINT) AS "offset" FROM part), s AS (SELECT p_brand path, max(p_partkey) + 3 size FROM part GROUP BY 1)
SELECT path, CAST(0 AS INTEGER) AS axis, "offset", coalesce(lead("offset") OVER (PARTITION BY path ORDER BY "offset"), size) - "offset" width FROM o JOIN s USING (path)""")
def f3_common_grid(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    c = part.select(F.col("p_brand").alias("path"), F.array(F.floor(F.col("p_partkey") / 3) * 3).alias("offset"))
    shapes = part.groupBy(F.col("p_brand").alias("path")).agg(F.array(F.max("p_partkey") + 3).alias("shape"))
    return chunks.common_grid(c, shapes)


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) iteration, o_orderpriority path, o_custkey source_id, o_orderkey seq, CAST(coalesce(sum(o_orderkey % 10) OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY o_custkey, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) joined_offset FROM orders""")
def f1_joined_offsets(spark, sf_dir):
    c = V.table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("iteration"), F.col("o_orderpriority").alias("path"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 10).alias("n"))
    return chunks.joined_offsets(c).drop("n")


@query("SELECT o_orderpriority path, CAST(sum(o_orderkey % 10) AS BIGINT) joined_extent, CAST(1 AS BIGINT) others FROM orders GROUP BY 1")
def e9_joined_extent(spark, sf_dir):
    c = V.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("path"), F.array(F.col("o_orderkey") % 10, F.lit(3).cast("long")).alias("extent"))
    return chunks.joined_extent(c)


@query("""WITH c AS (SELECT DISTINCT p_brand path, CAST(p_partkey // 20 AS BIGINT) i0, CAST(p_partkey % 20 AS BIGINT) i1 FROM part WHERE p_size > 10) SELECT path, count(*) cells FROM c GROUP BY 1""")
def f2_written_chunks(spark, sf_dir):
    """Cells of the boxes that the written cells of each brand make up; the boxes are disjoint and cover just them."""
    part = V.table(spark, sf_dir, "part").filter("p_size > 10")
    cells = part.select(F.col("p_brand").alias("path"), F.floor(F.col("p_partkey") / 20).alias("i0"), (F.col("p_partkey") % 20).alias("i1"))
    boxes = chunks.written_chunks(cells, 2)
    return boxes.groupBy("path").agg(F.sum(F.get("extent", 0) * F.get("extent", 1)).alias("cells"))


@query("SELECT o_orderkey, CAST(r AS INTEGER) AS part, CAST(o_orderkey // 7 * r + ceil((o_orderkey % 7) * r / 7) AS BIGINT) AS start FROM orders, (SELECT unnest(range(7)) r)")
def f6_balanced_split(spark, sf_dir):
    return slicing.split_rows(V.table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), 7).drop("extent")


@query("SELECT o_custkey cell, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def h2_merged_writes(spark, sf_dir):
    w = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("write_seq"), F.col("o_totalprice").alias("value"))
    return chunks.merged(w, ["cell"])


@query("SELECT p_partkey path, CAST(p_size AS BIGINT) o0, row_number() OVER (ORDER BY p_size, p_partkey) n FROM part")
def g5_sorted_chunks(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("o0"))
    lo, hi = part.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    part = part.withColumn("key", F.col("o0") * F.lit((hi or 0) - (lo or 0) + 1) + F.col("p_partkey") - F.lit(lo or 0))  # size first, and room for all keys
    return numbered(part, [], ["key"], "n").select(F.col("p_partkey").alias("path"), "o0", (F.col("n") + 1).alias("n"))


# Replay, summaries, storage -----------------------------------------------------------------------


@query(f"WITH {V.LOG} SELECT series, iteration, write_seq, value, write_seq position_key FROM g QUALIFY row_number() OVER (PARTITION BY series, iteration ORDER BY write_seq) = 1")
def f5_replay_first(spark, sf_dir):
    return replay.replay(V.log(spark, sf_dir), "first", ["series"])


@query(f"WITH {V.LOG} SELECT series, iteration, write_seq, value, iteration position_key FROM g QUALIFY row_number() OVER (PARTITION BY series, iteration ORDER BY write_seq) = 1")
def g1_replay_ascending(spark, sf_dir):
    return replay.replay(V.log(spark, sf_dir), "ascending", ["series"])


@query(f"WITH {V.LOG} SELECT series, iteration, write_seq, value, write_seq position_key FROM g QUALIFY row_number() OVER (PARTITION BY series, iteration ORDER BY write_seq DESC) = 1")
def f5_replay_last(spark, sf_dir):
    return replay.replay(V.log(spark, sf_dir), "last", ["series"])


@query(f"WITH {V.LOG} SELECT series, iteration, write_seq, value, write_seq position_key FROM (SELECT *, max(iteration) OVER (PARTITION BY series ORDER BY write_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM g) WHERE m IS NULL OR iteration > m")
def f4_replay_running_max(spark, sf_dir):
    return replay.replay(V.log(spark, sf_dir), "running_max", ["series"])


@query("SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [0] WHEN event_id % 3 = 1 THEN [user_id] ELSE [user_id, user_id + 1] END) iteration FROM events")
def i6_snapshots(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    own = F.when(F.col("event_id") % 3 == 1, F.array("user_id")).when(F.col("event_id") % 3 == 2, F.array("user_id", F.col("user_id") + 1))
    return replay.snapshots(e.select("event_id", own.alias("snapshot"))).select("event_id", "iteration")


@query("SELECT o_custkey, o_orderkey iteration FROM orders QUALIFY (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) % 5 = 1")
def g4_every_fifth(spark, sf_dir):
    its = V.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("iteration"))
    return replay.every(its, 5, 1, ["o_custkey"])


def _components(spark, sf_dir):
    p = V.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") < "m", "mesh").otherwise("particle")
    return p.select(F.col("user_id").alias("iteration"), kind.alias("kind"), F.col("event_type").alias("owner"), F.get_json_object("props", "$.k").alias("record"))


@query("SELECT count(DISTINCT user_id) iterations, list_sort(list(DISTINCT event_type) FILTER (event_type < 'm')) meshes, list_sort(list(DISTINCT event_type) FILTER (event_type >= 'm')) species FROM events")
def e6_listing(spark, sf_dir):
    return summary.listing(_components(spark, sf_dir))


@query("SELECT user_id iteration, coalesce(list_sort(list(DISTINCT event_type) FILTER (event_type < 'm')), []) meshes, coalesce(list_sort(list(DISTINCT event_type) FILTER (event_type >= 'm')), []) species, count(DISTINCT event_type || '/' || json_extract_string(props, '$.k')) records FROM events GROUP BY 1")
def e7_by_iteration(spark, sf_dir):
    return summary.by_iteration(_components(spark, sf_dir))


@query("SELECT u iteration, CASE WHEN t < 'm' THEN 'mesh' ELSE 'particle' END kind, t AS owner FROM (SELECT DISTINCT user_id u FROM events) CROSS JOIN (SELECT DISTINCT event_type t FROM events) WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = u AND event_type = t)")
def d7_missing(spark, sf_dir):
    return summary.missing(_components(spark, sf_dir))


@query("SELECT l_returnflag config, l_linestatus backend, CAST(l_linenumber AS BIGINT) ranks, 'DOUBLE' dtype, CAST(10 AS BIGINT) iterations, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) mean_write_s, max(l_quantity) max_write_s, max(l_tax) max_read_s FROM lineitem GROUP BY ALL")
def e10_timings(spark, sf_dir):
    r = V.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("backend"), F.col("l_linenumber").cast("long").alias("ranks"), F.lit("DOUBLE").alias("dtype"), F.lit(10).cast("long").alias("iterations"), F.col("l_quantity").alias("write_s"), F.col("l_tax").alias("read_s"))
    return summary.timings(r).drop("mean_read_s")


@query("SELECT 'data' || CASE WHEN length(CAST(o_orderkey * 97 AS VARCHAR)) < 6 THEN lpad(CAST(o_orderkey * 97 AS VARCHAR), 6, '0') ELSE CAST(o_orderkey * 97 AS VARCHAR) END || '.h5' AS name, o_orderkey * 97 iteration, 'hdf5' format FROM orders WHERE o_orderkey % 3 != 0")
def a1_discover_files(spark, sf_dir):
    key = F.col("o_orderkey") * 97
    names = V.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("other"), key.cast("string"))).otherwise(files.file_name("data", key, 6, ".h5")).alias("name"))
    return files.discover(names, "data%06T.%E").select("name", "iteration", files.file_format("name").alias("format"))


@query("SELECT o_orderstatus prefix, count(DISTINCT greatest(length(CAST(o_orderkey AS VARCHAR)), 4)) widths, CASE WHEN min(greatest(length(CAST(o_orderkey AS VARCHAR)), 4)) = max(greatest(length(CAST(o_orderkey AS VARCHAR)), 4)) THEN CAST(max(greatest(length(CAST(o_orderkey AS VARCHAR)), 4)) AS INTEGER) END AS padding FROM orders GROUP BY 1")
def a2_padding(spark, sf_dir):
    names = V.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("prefix"), files.file_name("data", "o_orderkey", 4, ".json").alias("name"))
    return files.padding(files.discover(names, "data%T.json"), ("prefix",))


@query("SELECT year(l_shipdate) iteration, count(*) n, CAST(sum(l_orderkey) AS BIGINT) keys FROM lineitem WHERE year(l_shipdate) IN (1996, 1998) GROUP BY 1")
def a5_a6_a9_written_and_read(spark, sf_dir):
    """A species written by iteration and read by iteration; only two folders are touched."""
    path = scratch(spark, "series")
    series.write(V.particles(spark, sf_dir).select("iteration", "id", "position_z"), path, "fileBased")
    return series.read(spark, path, [1996, 1998]).groupBy("iteration").agg(F.count("*").alias("n"), F.sum("id").alias("keys"))


@query("SELECT year(l_shipdate) iteration, count(*) + CASE WHEN year(l_shipdate) = 1997 THEN count(*) ELSE 0 END n FROM lineitem WHERE year(l_shipdate) < 1999 GROUP BY year(l_shipdate)")
def a10_a11_append(spark, sf_dir):
    """A series made anew, then appended to twice, with one iteration written again."""
    path, p = scratch(spark, "appended"), V.particles(spark, sf_dir).select("iteration", "id")
    series.write(p.filter("iteration < 1997").withColumn("write_seq", F.lit(0).cast("long")), path, "groupBased")
    series.append(p.filter("iteration between 1997 and 1998"), path, 1, "groupBased")
    series.append(p.filter("iteration = 1997"), path, 2, "groupBased")
    return series.read(spark, path).groupBy("iteration").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE o_totalprice END price FROM orders
UNION ALL SELECT o_orderkey + 100000000, NULL, 1.0 FROM orders WHERE o_orderkey % 8 = 0""")
def a12_read_write(spark, sf_dir):
    """One component of some rows overwritten, some rows added, the rest untouched."""
    old = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    new = old.filter("o_orderkey % 4 = 0").select("o_orderkey", F.lit(1.0).alias("price"))
    more = old.filter("o_orderkey % 8 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit(1.0).alias("price"))
    return series.upserted(old, new.unionByName(more), ["o_orderkey"]).select("o_orderkey", "o_custkey", "price")


@query("SELECT event_id, event_type, value FROM events")
def a13_csv(spark, sf_dir):
    path = scratch(spark, "csv")
    series.write_csv(V.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return spark.read.option("header", True).schema("event_id long, event_type string, value double").csv(path)


@query("SELECT year(l_shipdate) iteration, l_orderkey id, l_quantity * 2.0 position_z FROM lineitem")
def a14_a16_a18_j1_pipe(spark, sf_dir):
    """A species copied into another encoding and compression, through a transformation."""
    path, p = scratch(spark, "piped"), V.particles(spark, sf_dir).select("iteration", "id", "position_z")
    series.pipe({"electrons": p}, path, "variableBased", "gzip", lambda df: df.withColumn("position_z", F.col("position_z") * 2.0))
    return series.read(spark, f"{path}/electrons").select("iteration", "id", "position_z")


@query("SELECT year(l_shipdate) iteration, count(*) n FROM lineitem GROUP BY 1")
def a17_defragmented(spark, sf_dir):
    path = scratch(spark, "defragmented")
    p = V.particles(spark, sf_dir).select("iteration", F.col("id").alias("row"), "position_z")
    series.write(series.defragmented(p, 8), path, "groupBased")
    return series.read(spark, path).groupBy("iteration").agg(F.count("*").alias("n"))


@query("SELECT o_custkey file, iteration, CAST(len(list(o_totalprice)) AS BIGINT) n, arg_min(o_totalprice, o_orderkey) AS first, 'rho' AS record, 'DOUBLE' dtype FROM (SELECT *, o_orderkey % 3 iteration FROM orders) GROUP BY o_custkey, iteration")
def a3_a7_decoded_documents(spark, sf_dir):
    """Orders as small JSON documents, one a customer with an iteration for each rest of the key, decoded again; a broken one each is skipped."""
    orders = V.table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("iteration"), F.struct("o_orderkey", "o_totalprice").alias("o"))
    mesh = orders.groupBy("o_custkey", "iteration").agg(F.sort_array(F.collect_list("o"))["o_totalprice"].alias("data"))
    dataset = F.struct(F.struct(F.struct(F.struct(F.lit("DOUBLE").alias("datatype"), "data").alias("rho"), F.lit(1).alias("broken")).alias("meshes")).alias("v"))
    body = F.concat(F.lit('{"data":{'), F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("iteration").cast("string"), F.lit('":'), F.get_json_object(F.to_json(dataset), "$.v"))), ","), F.lit("}}"))
    found = documents.decode(mesh.groupBy("o_custkey").agg(body.cast("binary").alias("content")).select(F.col("o_custkey").cast("string").alias("path"), "content"))
    good = found.filter("error is null and kind = 'dataset'")
    return good.select(F.col("file").cast("long").alias("file"), "iteration", F.get("shape", 0).alias("n"), F.get("data", 0).alias("first"), F.element_at(F.split("path", "/"), -1).alias("record"), "dtype")


@query("""SELECT i0, CASE WHEN i0 < n THEN o_totalprice ELSE -1.0 END AS value FROM (SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders) i0, o_totalprice FROM orders), (SELECT max(o_orderkey) - min(o_orderkey) + 1 n FROM orders)
UNION ALL SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders) + n, -1.0 FROM orders, (SELECT max(o_orderkey) - min(o_orderkey) + 1 n FROM orders)""")
def h3_extended(spark, sf_dir):
    """A component grown to twice its length: old values stay, new rows are added."""
    orders = V.table(spark, sf_dir, "orders")
    lo, hi = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    n = hi - lo + 1
    old = orders.select((F.col("o_orderkey") - lo).alias("i0"), F.col("o_totalprice").alias("value"))
    new = old.select((F.col("i0") + n).alias("i0"), F.lit(-1.0).alias("value"))
    return chunks.extend(old, [n], [2 * n]).unionByName(new)


@query("SELECT label iteration, vec_id block, CASE WHEN label % 3 = 1 AND vec_id % 10 = 1 THEN 2 ELSE 1 END copies FROM embeddings WHERE NOT (label % 3 = 1 AND vec_id % 10 = 0)")
def k3_unbalanced(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(F.col("label").alias("iteration"), F.col("vec_id").alias("block"))
    return generate.unbalanced(e).groupBy("iteration", "block").agg(F.max("copy").alias("copies"))


@query("SELECT event_type series, user_id iteration, min(event_id) write_seq FROM events GROUP BY ALL")
def i1_i3_i8_stream(spark, sf_dir):
    """The log read as a stream, defective steps put aside, written to a sink; repeated steps dropped on reading."""
    path, check = scratch(spark, "stream"), scratch(spark, "stream-state")
    log = V.log(spark, sf_dir).select("series", "iteration", "write_seq")
    source = scratch(spark, "steps")
    log.write.parquet(source)
    good, _ = steps.split_defective(steps.read_steps(spark, source, log.schema), F.col("iteration").isNotNull())
    steps.capture(good, {"first": lambda b: replay.replay(b, "first", ["series"]).drop("position_key")}, path, check, "write_seq").awaitTermination()
    return replay.replay(spark.read.parquet(f"{path}/first").select("series", "iteration", "write_seq"), "first", ["series"]).select("series", "iteration", "write_seq")


@query(f"WITH {V.LOG} SELECT series, write_seq, iteration FROM (SELECT *, max(iteration) OVER (PARTITION BY series ORDER BY write_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM g) WHERE m IS NULL OR iteration > m")
def i4_i5_stream_running_max(spark, sf_dir):
    """The log as a stream whose state is each series' greatest iteration so far; steps in the order of writing."""
    source, out, state = (scratch(spark, n) for n in ("late-steps", "late", "late-state"))
    log = V.log(spark, sf_dir).select("series", "write_seq", "iteration")
    lo, hi = log.agg(F.min("write_seq"), F.max("write_seq")).first()
    for k in range(4):  # a folder for each quarter of the log, one after another, and as many files as Spark makes of it
        part = F.floor((F.col("write_seq") - lo) * 4 / (hi - lo + 1))
        log.filter(part == k).write.parquet(f"{source}/{k}")
        stream = steps.read_steps(spark, f"{source}/*", "series string, write_seq long, iteration long", 1 << 20)
        steps.running_max_capture(stream, out, state).awaitTermination()
    return spark.read.schema("series string, write_seq long, iteration long").parquet(f"{out}/steps").select("series", "write_seq", "iteration")


@query("SELECT user_id iteration, event_type path FROM (SELECT DISTINCT user_id, event_type FROM events) e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.value > 50)")
def d7_uncovered(spark, sf_dir):
    """Components of which no chunk was written: types of a user without a value over 50."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("iteration"), F.col("event_type").alias("path"), "value")
    return summary.uncovered(e.filter("value > 50"), e.select("iteration", "path").distinct())


# Further parts: whole operators whose other queries only take a part of them ------------------------


@query(f"WITH {V.CELLS} SELECT iteration, i0, i1, v AS value FROM e")
def blocks_unfolded(spark, sf_dir):
    """All cells of all blocks."""
    return meshes.blocks_to_cells(V.blocks(spark, sf_dir), 2)


@query("""WITH c AS (SELECT DISTINCT p_brand path, CAST(p_partkey // 3 AS BIGINT) i0 FROM part WHERE p_size > 10),
r AS (SELECT path, i0, i0 - row_number() OVER (PARTITION BY path ORDER BY i0) run FROM c)
SELECT path, min(i0) o0, count(*) e0 FROM r GROUP BY path, run""")
def f2_written_runs(spark, sf_dir):
    """The boxes themselves, of a dataset of one axis."""
    part = V.table(spark, sf_dir, "part").filter("p_size > 10")
    boxes = chunks.written_chunks(part.select(F.col("p_brand").alias("path"), F.floor(F.col("p_partkey") / 3).alias("i0")), 1)
    return boxes.select("path", F.get("offset", 0).alias("o0"), F.get("extent", 0).alias("e0"))


@query("""WITH s AS (SELECT o_orderkey, CAST(r AS INTEGER) AS part, CAST(o_orderkey // 7 * r + ceil((o_orderkey % 7) * r / 7) AS BIGINT) AS start FROM orders, (SELECT unnest(range(7)) r))
SELECT *, coalesce(lead(start) OVER (PARTITION BY o_orderkey ORDER BY part), o_orderkey) - start AS extent FROM s""")
def f6_balanced_extents(spark, sf_dir):
    return slicing.split_rows(V.table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), 7)


@query(f"""WITH {V.PARTICLES} SELECT iteration, species, CAST("row" // 500 AS BIGINT) chunk, count(*) n, CAST(sum(id) AS BIGINT) ids, max(momentum_z) top FROM p GROUP BY ALL""")
def j2_chunk_function(spark, sf_dir):
    """A pandas function over each chunk of a species."""

    def summed(pdf):
        head = pdf.iloc[:1][["iteration", "species"]]
        return head.assign(chunk=int(pdf["row"].iloc[0]) // 500, n=len(pdf), ids=int(pdf["id"].sum()), top=float(pdf["momentum_z"].max()))

    return particles.map_chunks(V.numbered_particles(spark, sf_dir), summed, "iteration long, species string, chunk long, n long, ids long, top double", 500)


@query("SELECT event_type series, user_id iteration, event_id write_seq FROM events WHERE NOT coalesce(value > 5, FALSE)")
def i7_defective_steps(spark, sf_dir):
    """The log as a stream; steps that aren't as they should be go to a table of their own."""
    path, check, source = (scratch(spark, n) for n in ("sorted-steps", "sorted-state", "mixed-steps"))
    log = V.log(spark, sf_dir).select("series", "iteration", "write_seq", "value")
    log.write.parquet(source)
    stream = steps.read_steps(spark, source, log.schema)
    steps.capture(stream, {"good": lambda b: steps.split_defective(b, F.col("value") > 5)[0], "defective": lambda b: steps.split_defective(b, F.col("value") > 5)[1]}, path, check).awaitTermination()
    return spark.read.parquet(f"{path}/defective").select("series", "iteration", "write_seq")


@query("SELECT DISTINCT user_id iteration, event_type series FROM events")
def i2_first_writes_stream(spark, sf_dir):
    """Repeated steps of a stream dropped as they come, each step for the iterations of its snapshot."""
    source, out, state = (scratch(spark, n) for n in ("repeated-steps", "first-steps", "first-state"))
    log = V.log(spark, sf_dir).select("series", F.array("iteration").alias("snapshot"))
    log.write.parquet(source)
    stream = steps.first_writes(steps.expanded(steps.read_steps(spark, source, log.schema)), ["series", "iteration"]).select("iteration", "series")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("iteration long, series string").parquet(out)


@query("SELECT event_type series, user_id iteration, max(event_id) write_seq, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def a9_variable_based(spark, sf_dir):
    """A variable-based log written to storage and read back: snapshots resolved, the last write of an iteration counts."""
    path = scratch(spark, "variable")
    series.write(V.log(spark, sf_dir), path, "variableBased")
    return series.read_variable(spark, path, ["series"]).select("series", "iteration", "write_seq", "value")


@query("""SELECT year(l_shipdate) iteration, count(*) n, CAST(sum(CASE WHEN year(l_shipdate) = 1996 THEN -l_orderkey ELSE l_orderkey END) AS BIGINT) keys FROM lineitem GROUP BY 1""")
def a12_overwritten_iteration(spark, sf_dir):
    """One iteration of a stored series replaced; the others aren't touched."""
    path, p = scratch(spark, "replaced"), V.particles(spark, sf_dir).select("iteration", "id")
    series.write(p, path, "fileBased")
    series.overwrite_iterations(p.filter("iteration = 1996").withColumn("id", -F.col("id")), path)
    return series.read(spark, path).groupBy("iteration").agg(F.count("*").alias("n"), F.sum("id").alias("keys"))


@query(f"""WITH {V.PARTICLES}, t AS (SELECT 'electrons' AS name, iteration, "row" place, 2 * position_z AS value FROM p WHERE species = 'A'
UNION ALL SELECT 'field', CAST(label AS BIGINT), vec_id, CAST(embedding[1] AS DOUBLE) FROM embeddings
UNION ALL SELECT 'attributes', event_id, NULL, NULL FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)
SELECT name, iteration, count(*) n, CAST(sum(place) AS BIGINT) places, max(value) top FROM t GROUP BY ALL""")
def a16_whole_pipe(spark, sf_dir):
    """A series with a species, a field and attributes, some of it written twice, copied: last writes, another layout, compression and encoding, read back."""
    path = scratch(spark, "whole-pipe")
    seq = lambda df, k: df.withColumn("write_seq", F.lit(k).cast("long"))
    p = V.numbered_particles(spark, sf_dir).filter("species = 'A'").select("iteration", "row", F.col("position_z").alias("value"))
    electrons = seq(p.filter("row % 3 = 0").withColumn("value", F.lit(-1.0)), 0).unionByName(seq(p, 1))
    field = seq(V.vectors(spark, sf_dir).select("iteration", "i0", F.col("x").alias("value")), 0)
    made = V.attributes(spark, sf_dir).filter("name = 'k'").withColumn("node_type", F.lit("series"))
    own = made.withColumn("name", F.lit("version")).unionByName(made)
    series.pipe({"electrons": electrons, "attributes": own}, path, "groupBased", "gzip", lambda df: df.withColumn("value", F.col("value") * 2), "version", files=4)
    series.pipe({"field": field}, path, "fileBased", "zstd", files=4)
    found = [series.read(spark, f"{path}/{n}").select(F.lit(n).alias("name"), "iteration", F.col(c).cast("long").alias("place"), F.col(v).alias("value")) for n, c, v in (("electrons", "row", "value"), ("field", "i0", "value"))]
    found.append(spark.read.parquet(f"{path}/attributes").select(F.lit("attributes").alias("name"), "iteration", F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("value")))
    both = found[0].unionByName(found[1]).unionByName(found[2])
    return both.groupBy("name", "iteration").agg(F.count("*").alias("n"), F.sum("place").alias("places"), F.max("value").alias("top"))


@query("""WITH n AS (SELECT p_partkey iteration, CASE p_size % 3 WHEN 0 THEN 'iteration' WHEN 1 THEN 'component' ELSE 'free' END node_type, p_size FROM part),
w AS (SELECT *, unnest(CASE node_type WHEN 'iteration' THEN ['dt', 'time', 'timeUnitSI'] WHEN 'component' THEN ['unitSI'] ELSE [] END) AS name FROM n)
SELECT iteration, '/' AS path, node_type, name, CASE WHEN name = 'time' OR p_size % 2 = 0 THEN 'missing' ELSE 'type' END problem FROM w WHERE NOT (name = 'dt' AND p_size % 2 = 1)""")
def a8_required_by_type(spark, sf_dir):
    """What nodes lack of the attributes that their type must have, or have in another type."""
    pick = F.element_at(F.array(*map(F.lit, ("iteration", "component", "free"))), (F.col("p_size") % 3 + 1).cast("int"))
    nodes = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("iteration"), F.lit("/").alias("path"), pick.alias("node_type"), "p_size")
    have = nodes.filter("p_size % 2 = 1").select("iteration", "path", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("dt", "timeUnitSI", "unitSI"))), F.array(*map(F.lit, ("0.5", '"wrong"', "[1.0, 2.0]"))))).alias("name", "value"))
    have = have.withColumn("dtype", F.when(F.col("name") == "dt", "DOUBLE").when(F.col("name") == "unitSI", "VEC_DOUBLE").otherwise("STRING"))
    return attrs.required_violations(nodes, have)


@query("SELECT CAST(o_orderkey AS BIGINT) + 9007199254740993 big, o_orderkey % 2 = 0 AS even FROM orders")
def c2_exact_integers(spark, sf_dir):
    """Integers beyond the 53 bits of doubles stay exact."""
    rows = V.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + F.lit(9007199254740993)).cast("string").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false").alias("flag"))
    return rows.select(attrs.converted(F.col("value"), F.lit("LONG"), "long").alias("big"), (attrs.converted(F.col("flag"), F.lit("BOOL"), "long") == 1).alias("even"))


@query("SELECT c_custkey AS file, CAST(c_nationkey AS BIGINT) AS iteration, 'LONG' AS dtype, c_custkey * 90071992547409 AS first FROM customer")
def a4_toml_documents(spark, sf_dir):
    """Customers as small TOML documents, decoded; integers are exact."""
    c = V.table(spark, sf_dir, "customer")
    body = F.format_string("[data.%d.meshes.n]\ndatatype = 'LONG'\ndata = [%d, 1]\n", F.col("c_nationkey").cast("long"), F.col("c_custkey") * F.lit(90071992547409))
    found = documents.decode(c.select(F.col("c_custkey").cast("string").alias("path"), body.cast("binary").alias("content")), toml=True).filter("kind = 'dataset'")
    return found.select(F.col("file").cast("long").alias("file"), "iteration", "dtype", F.get("exact", 0).cast("long").alias("first"))


@query("SELECT o_custkey file, CASE WHEN o_custkey % 2 = 0 THEN '/data/0/meshes/n' ELSE '/data/0/meshes' END path, CASE WHEN o_custkey % 2 = 0 THEN 'dataset' ELSE 'group' END kind FROM (SELECT DISTINCT o_custkey FROM orders)")
def a7_reported_errors(spark, sf_dir):
    """Documents with a part that can't be read: the part is reported, and where it is."""
    c = V.table(spark, sf_dir, "orders").select("o_custkey").distinct()
    bad = F.when(F.col("o_custkey") % 2 == 0, F.lit('{"n":{"datatype":"LONG","data":[1,null]},"m":{"datatype":"LONG","data":[7]}}')).otherwise(F.lit("3"))
    body = F.concat(F.lit('{"data":{"0":{"meshes":'), bad, F.lit("}}}"))
    found = documents.problems(documents.decode(c.select(F.col("o_custkey").cast("string").alias("path"), body.cast("binary").alias("content"))).withColumn("name", F.col("kind")))
    return found.select(F.col("file").cast("long").alias("file"), "path", F.col("name").alias("kind"))


@query("""SELECT CAST(s AS BIGINT) iteration, CAST(b AS BIGINT) block, CAST(i AS BIGINT) i, b + 0.01::DOUBLE * s + i * 0.0001::DOUBLE rho
FROM (SELECT unnest(range(3)) s), (SELECT unnest(range((SELECT count(*) FROM supplier))) b), (SELECT unnest(range(10)) i)""")
def k1_made_fields(spark, sf_dir):
    """A made field with as many blocks as there are suppliers."""
    return generate.fields(spark, V.table(spark, sf_dir, "supplier").count(), 10, 3)


@query("""SELECT CAST(s AS BIGINT) iteration, CAST(b * 10 + i AS BIGINT) AS "row", 0.1::DOUBLE * s + 0.0001::DOUBLE * i charge, 1.0::DOUBLE * s + 0.0002::DOUBLE * i position_x
FROM (SELECT unnest(range(3)) s), (SELECT unnest(range((SELECT count(*) FROM supplier))) b), (SELECT unnest(range(10)) i)""")
def k2_made_particles(spark, sf_dir):
    """Made particles with as many blocks as there are suppliers."""
    return generate.particles(spark, V.table(spark, sf_dir, "supplier").count(), 10, 3).select("iteration", "row", "charge", "position_x")


@query("SELECT n * 100 AS cells, n * 100 AS places, true AS inside FROM (SELECT count(*) n FROM supplier)")
def k4_random_integers(spark, sf_dir):
    """Random cells, 100 for each supplier: all places, values in their range."""
    found = generate.random_integers(spark, [V.table(spark, sf_dir, "supplier").count(), 100])
    return found.agg(F.count("*").alias("cells"), F.count_distinct("linear_index").alias("places"), (F.min("value").between(0, 200_000_000) & F.max("value").between(0, 200_000_000)).alias("inside"))


@query("SELECT CAST(label AS BIGINT) iteration, vec_id i0, CAST(embedding[1] AS DOUBLE) AS value, 'double' AS kind FROM embeddings")
def b14_empty_component(spark, sf_dir):
    """An empty component, typed, whose rows are written later: all columns and their types are those it was made with."""
    made = meshes.empty(spark, "double", 1)
    found = made.unionByName(V.vectors(spark, sf_dir).select("iteration", "i0", F.col("x").alias("value")), allowMissingColumns=True)
    return found.select("iteration", "i0", "value", F.lit(dict(made.dtypes)["value"]).alias("kind"))


@query("SELECT vec_id i0, CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) + CAST(embedding[len(embedding)] AS DOUBLE) * CAST(embedding[len(embedding)] AS DOUBLE) AS first, CAST(len(embedding) AS INTEGER) n FROM embeddings")
def b16_block_intensity(spark, sf_dir):
    """Sums of squares of two arrays, block by block: the values of each block and the same in reverse."""
    both = V.blocks(spark, sf_dir).select(F.get("offset", 0).alias("i0"), "values", F.reverse("values").alias("reversed"))
    both = both.select("i0", meshes.block_intensity("values", "reversed").alias("intensity"))
    return both.select("i0", F.get("intensity", 0).alias("first"), F.size("intensity").alias("n"))


@query(f"WITH {V.PARTICLES} SELECT iteration, species, count(*) n, true AS contiguous FROM p GROUP BY ALL")
def a17_chunks_of_files(spark, sf_dir):
    """A species laid out anew: what a file has of an iteration and species is one run of rows."""
    path = scratch(spark, "runs")
    p = V.numbered_particles(spark, sf_dir).select("iteration", "species", "row", "position_z")
    series.write(series.defragmented(p, 8, ("iteration", "species", "row")), path, "groupBased")
    runs = series.read(spark, path).groupBy(F.col("_metadata.file_path").alias("file"), "iteration", "species").agg(F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    return runs.groupBy("iteration", "species").agg(F.sum("n").alias("n"), F.bool_and(F.col("hi") - F.col("lo") + 1 == F.col("n")).alias("contiguous"))
