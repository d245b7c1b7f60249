import json
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meshframe.functions.slicing import Region
from meshframe.jobs import generate
from meshframe.operators import chunks, histograms, meshes, numbering, particles, patches, replay
from meshframe.sources import documents, series
from meshframe.streaming import steps


def test_cells_blocks_cells(spark):
    cells = spark.range(60).select(F.lit(1).alias("iteration"), F.floor(F.col("id") / 10).alias("i0"), (F.col("id") % 10).alias("i1"), F.col("id").cast("double").alias("value"))
    blocks = meshes.cells_to_blocks(cells, (4, 3), (6, 10))
    assert blocks.count() == 8 and blocks.filter("size(values) != extent[0] * extent[1]").count() == 0
    back = meshes.blocks_to_cells(blocks, 2)
    assert back.exceptAll(cells.select(back.columns)).count() == 0 and back.count() == 60
    box = Region((2, 3), (2, 4))
    assert {r["value"] for r in meshes.load_chunk(meshes.blocks_to_cells(blocks, 2, box=box), box).collect()} == {float(10 * i + j) for i in (2, 3) for j in range(3, 7)}


def test_constant_empty_dense(spark):
    assert meshes.constant(spark, (1, 2, 3), 13.37).agg(F.count("*"), F.min("value"), F.max("value")).first()[:] == (6, 13.37, 13.37)
    assert meshes.empty(spark, "double", 2).count() == 0
    some = spark.createDataFrame([(0, 1, 5.0)], "i0 long, i1 long, value double")
    assert sum(r["value"] != r["value"] for r in meshes.densified(some, (2, 2)).collect()) == 3
    with pytest.raises(TypeError):
        meshes.densified(some.withColumn("value", F.lit(1)), (2, 2))
    with pytest.raises(ValueError):
        meshes.grid_block((5, 4), (2, 2))
    assert meshes.auto_widths((1024, 1024), 8, 1 << 20) == [128, 1024]


def test_field_max_takes_the_first(spark):
    cells = spark.createDataFrame([(1, 0, 2.0), (1, 1, 5.0), (1, 2, 5.0), (2, 4, -1.0)], "iteration long, i0 long, v double")
    assert {tuple(r) for r in meshes.field_max(cells, "v", ["i0"]).collect()} == {(1, 5.0, 1), (2, -1.0, 4)}


def test_chunks_are_rebuilt(spark):
    written = {(i, j) for i in range(2, 7) for j in range(4)} | {(i, j) for i in (7, 8) for j in (0, 1)} | {(i, 3) for i in (8, 9)}
    df = spark.createDataFrame([("x", *c) for c in written], "path string, i0 long, i1 long")
    got = {(tuple(r["offset"]), tuple(r["extent"])) for r in chunks.written_chunks(df, 2).collect()}
    assert got == {((2, 0), (5, 4)), ((7, 0), (2, 2)), ((8, 3), (2, 1))}
    two = [((1, 0), (2, 4)), ((4, 2), (3, 2)), ((6, 0), (4, 1))]
    df = spark.createDataFrame([("y", i, j) for (a, b), (m, n) in two for i in range(a, a + m) for j in range(b, b + n)], "path string, i0 long, i1 long")
    assert {(tuple(r["offset"]), tuple(r["extent"])) for r in chunks.written_chunks(df, 2).collect()} == set(two)


def test_random_masks_are_covered_once(spark):
    rng = random.Random(5)
    cells = [(f"m{m}", i, j, k) for m in range(12) for i in range(4) for j in range(5) for k in range(4) if rng.random() < 0.2 + m / 16]
    found = chunks.written_chunks(spark.createDataFrame(cells, "path string, i0 long, i1 long, i2 long"), 3).collect()
    covered = [(r["path"], i, j, k) for r in found for i in range(r["offset"][0], r["offset"][0] + r["extent"][0]) for j in range(r["offset"][1], r["offset"][1] + r["extent"][1]) for k in range(r["offset"][2], r["offset"][2] + r["extent"][2])]
    assert sorted(covered) == sorted(cells)


def test_extension_rules():
    assert chunks.extended([5, 5], [10, 5]) == [10, 5] and chunks.extended([0, 1], [1, 2], "empty", "constant") == [1, 2]
    for old, new, kind, to in (([5, 5], [4, 5], "array", None), ([5], [5, 1], "array", None), ([5], [5], "array", "constant"), ([5], [5], "constant", "empty"), ([5], [6], "array", "empty")):
        with pytest.raises(ValueError):
            chunks.extended(old, new, kind, to)


def test_overlap_once(spark):
    want = spark.createDataFrame([("p", [3], [40]), ("p", [90], [5]), ("p", [5], [0]), ("q", [3], [40])], "path string, offset array<long>, extent array<long>")
    have = spark.createDataFrame([("p", [10 * i], [10]) for i in range(10)], "path string, offset array<long>, extent array<long>")
    got = sorted((r["offset"][0], r["extent"][0]) for r in chunks.overlap(want, have, 1).collect())
    assert got == [(3, 7), (10, 10), (20, 10), (30, 10), (40, 3), (90, 5)]
    assert chunks.overlap(want.limit(0), have, 1).count() == 0 == chunks.overlap(want, have.limit(0), 1).count()


def test_numbering_and_prefixes(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i * i, i) for i in range(50)], "k string, o long, v long")
    for buckets in (1, 7):
        rows = numbering.exclusive_sum(numbering.numbered(df, ["k"], ["o"], buckets=buckets), ["k"], ["o"], "v", "before", buckets).collect()
        for k in ("a", None):
            own = sorted((r for r in rows if r["k"] == k), key=lambda r: r["o"])
            assert [r["row"] for r in own] == list(range(len(own))) and [r["before"] for r in own] == [sum(x["v"] for x in own[:i]) for i in range(len(own))]


def test_patches(spark):
    parts = spark.range(123).select(F.lit(42).alias("iteration"), F.lit("electrons").alias("species"), F.col("id").alias("row"), F.col("id").cast("float").alias("x"))
    table = spark.createDataFrame([(42, "electrons", 0, 10, 0, 0.0, 10.0), (42, "electrons", 1, 113, 10, 10.0, 113.0)], "iteration int, species string, patch_id int, num_particles long, num_particles_offset long, offset_x double, extent_x double")
    for width in (4, 1000):
        assert {r["patch_id"]: r["count"] for r in patches.in_patch(parts, table, width=width).groupBy("patch_id").count().collect()} == {0: 10, 1: 113}
        assert patches.violators(parts, table, ["x"], ["x"], width=width).count() == 0
        assert patches.in_patch(parts, table.filter("patch_id = 0"), width=width, how="left_semi").count() == 10
    assert patches.pruned(table, {"x": (0.0, 10.0)}).count() == 1


LOG = [0, 1, 3, 2, 4, 3, 10, 7, 1, 11]


@pytest.mark.parametrize(("policy", "expected"), [("ascending", [0, 1, 2, 3, 4, 7, 10, 11]), ("first", [0, 1, 3, 2, 4, 10, 7, 11]), ("running_max", [0, 1, 3, 4, 10, 11])])
def test_replay(spark, policy, expected):
    log = spark.createDataFrame(list(enumerate(LOG)), "write_seq long, iteration long")
    assert [r["iteration"] for r in replay.replay(log, policy).orderBy("position_key").collect()] == expected


def test_snapshots(spark):
    df = spark.createDataFrame([(1, None), (2, [1, 2, 3])], "s int, snapshot array<long>")
    assert sorted(r["iteration"] for r in replay.snapshots(df).collect()) == [0, 1, 2, 3]


def test_union_and_align(spark):
    a, b = spark.createDataFrame([(0, 1.0)], "row long, x double"), spark.createDataFrame([(0, 2.0)], "row long, y double")
    assert {tuple(r) for r in particles.union_iterations([a, b]).collect()} == {(0, 1.0, None), (0, None, 2.0)}
    with pytest.raises(ValueError):
        particles.align({"x": a.withColumnRenamed("x", "value"), "y": b.withColumnRenamed("y", "value").limit(0)}, ["row"])
    with pytest.raises(KeyError):
        particles.iterations(a.withColumn("iteration", F.lit(1)), 1, 2, strict=True)


def test_histogram_sums(spark):
    df = spark.range(1000).select((F.col("id") / 100).alias("v"), F.lit(0.5).alias("w"))
    h = histograms.histogram(df, "v", 10, 0.0, 5.0, F.col("w")).collect()
    assert len(h) == 10 and sum(r["weight"] for r in h) == 0.5 * 501


def test_upsert_and_dynamic_overwrite(spark, tmp_path):
    path = str(tmp_path / "s")
    old = spark.createDataFrame([(0, 0, 0.0, 0.0)], "iteration long, row long, x double, y double")
    series.write(old, path)
    new = series.upserted(old, spark.createDataFrame([(0, 0, 1.0)], "iteration long, row long, y double"), ["iteration", "row"])
    series.overwrite_iterations(new.unionByName(spark.createDataFrame([(1, 0, 1.0, None)], new.schema)), path)
    assert {(r["iteration"], r["x"], r["y"]) for r in series.read(spark, path).collect()} == {(0, 0.0, 1.0), (1, 1.0, None)}
    series.write(new.withColumn("iteration", F.lit(2)), path)
    assert [r["iteration"] for r in series.read(spark, path).collect()] == [2]
    with pytest.raises(ValueError):
        series.write(old, path, "none")


def test_json_documents(spark, tmp_path):
    tree = {"attributes": {"standard": {"datatype": "STRING", "value": "1.1.0"}}, "data": {"1": {"attributes": {"dt": {"datatype": "DOUBLE", "value": 1}}, "meshes": {"rho": {"attributes": {}, "datatype": "DOUBLE", "data": [[0, 1, None], [3, 4, 5]]}, "bad": {"datatype": "INT", "data": [None]}, "z": {"datatype": "CDOUBLE", "data": [[1, 2], [-3, 4]]}}}}}
    (tmp_path / "a.json").write_text(json.dumps(tree))
    (tmp_path / "b.json").write_text("{")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = documents.decode(files)
    sets = {r["path"].split("/")[-1]: r for r in found.filter("kind = 'dataset' and error is null").collect()}
    assert sets["rho"]["shape"] == [2, 3] and sets["rho"]["data"][2] != sets["rho"]["data"][2] and sets["rho"]["iteration"] == 1 and sets["z"]["shape"] == [2]
    assert documents.problems(found).count() == 2 and documents.components(found).count() == 3
    assert documents.read(spark, str(tmp_path)).filter("kind = 'attribute'").count() == 2
    with pytest.raises(ValueError):
        documents.read(spark, str(tmp_path), "b.json")
    (tmp_path / "c.toml").write_text('[data.5.meshes.rho]\ndatatype = "DOUBLE"\ndata = [1.0, 2.0]\n')
    assert documents.read(spark, str(tmp_path), "*.toml").filter("kind = 'dataset'").first()["iteration"] == 5


def test_streaming_running_max(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for n, part in enumerate(([0, 1], [3, 2], [4, 3, 10], [7, 1, 11])):
        spark.createDataFrame([("s", n * 10 + i, it) for i, it in enumerate(part)], "series string, write_seq long, iteration long").coalesce(1).write.mode("append").parquet(source)
    stream = steps.read_steps(spark, source, "series string, write_seq long, iteration long", 1)
    steps.running_max_capture(stream, out, state).awaitTermination(120)
    assert sorted(r["iteration"] for r in spark.read.parquet(f"{out}/steps").collect()) == [0, 1, 3, 4, 10, 11]
    assert sum(f.startswith("batch=") for f in os.listdir(f"{out}/state")) == 2


def test_generators(spark):
    rows = generate.fields(spark, 2, 3, 2)
    assert rows.count() == 12 and abs(rows.filter("iteration = 1 and block = 1 and i = 2").first()["rho"] - 1.0102) < 1e-12
    assert generate.particles(spark, 2, 5, 3).count() == 30 and generate.random_integers(spark, (4, 5)).filter("value between 0 and 200000000").count() == 20
    assert generate.unbalanced(spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "iteration long, block long")).count() == 4


def test_field_max_leaves_out_nulls_and_nan(spark):
    cells = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, 5.0), (1, 3, float("nan")), (2, 0, None)], "iteration long, i0 long, v double")
    assert {tuple(r) for r in meshes.field_max(cells, "v", ["i0"]).collect()} == {(1, 5.0, 2)}


def test_conversions_are_exact(spark):
    from meshframe.functions.attributes import converted

    rows = [("9007199254740993", "LONG"), ("18446744073709551615", "ULONG"), ("1.9", "DOUBLE"), ("-1.9", "DOUBLE"), ("true", "BOOL"), ('"a"', "STRING"), ("[9007199254740993, 2]", "VEC_LONG"), ('["a", "b"]', "VEC_STRING"), ("1e3", "DOUBLE")]
    df = spark.createDataFrame(rows, "value string, dtype string").coalesce(1)
    got = df.select(*(converted(F.col("value"), F.col("dtype"), t).alias(t) for t in ("long", "ulong", "double", "long_array", "string_array"))).collect()
    assert [r["long"] for r in got] == [9007199254740993, None, 1, -1, 1, 97, None, None, 1000]
    assert int(got[1]["ulong"]) == 18446744073709551615 and got[0]["double"] == 9007199254740992.0
    assert got[6]["long_array"] == [9007199254740993, 2] and got[7]["string_array"] == ["a", "b"] and got[7]["long_array"] is None


def test_numbers_of_long_tails(spark):
    from meshframe.operators import numbering

    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") == 9, F.lit(10**15)).otherwise(F.col("id")).alias("x")).unionByName(spark.createDataFrame([(1, None)], "k long, x long"))
    old, numbering.ROWS = numbering.ROWS, 50
    try:
        buckets = numbering._bucketed(df, "x", 64).groupBy("__bucket").count().collect()
        got = sorted((r["k"], r["row"], -1 if r["x"] is None else r["x"]) for r in numbering.numbered(df, ["k"], ["x"]).collect())
    finally:
        numbering.ROWS = old
    assert len(buckets) > 40 and max(r["count"] for r in buckets) < 300
    assert all(a[0] != b[0] or (a[1] + 1 == b[1] and a[2] <= b[2]) for a, b in zip(got[:-1], got[1:]))


def test_numbers_by_sampled_quantiles(spark):
    from meshframe.operators import numbering

    odd = [(float("nan"),), (float("inf"),), (float("-inf"),), (None,)]
    df = spark.range(4000).select((F.col("id") * 37 % 4001).cast("double").alias("x")).unionByName(spark.createDataFrame(odd, "x double"))
    old, (numbering.ROWS, numbering.SAMPLED) = (numbering.ROWS, numbering.SAMPLED), (100, 10)
    try:
        buckets = numbering._bucketed(df, "x", 64).groupBy("__bucket").count().collect()
        got = [r["x"] for r in sorted(numbering.numbered(df, [], ["x"]).collect(), key=lambda r: r["row"])]
    finally:
        numbering.ROWS, numbering.SAMPLED = old
    assert len(buckets) > 30 and max(r["count"] for r in buckets) < 500
    assert got[:2] == [None, float("-inf")] and got[2:-2] == sorted(got[2:-2]) and got[-2] == float("inf") and got[-1] != got[-1] and len(got) == 4004


def test_runs_of_one_axis(spark):
    from meshframe.operators import numbering

    cells = {(p, i) for p in ("a", None) for i in range(900) if i % 97 and (p or not 300 < i < 500)}
    want, ordered = {}, sorted(cells, key=lambda c: (c[0] or "", c[1]))
    for p, i in ordered:
        start = next(j for j in range(i, -2, -1) if (p, j - 1) not in cells)
        want[p, start] = want.get((p, start), 0) + 1
    old, (numbering.ROWS, chunks.RANGE) = (numbering.ROWS, chunks.RANGE), (20, 16)
    try:
        found = chunks.written_chunks(spark.createDataFrame([*ordered, *ordered[:50]], "path string, i0 long"), 1).collect()
        none = chunks.written_chunks(spark.createDataFrame([], "path string, i0 long"), 1).count()
    finally:
        numbering.ROWS, chunks.RANGE = old
    assert {(r["path"], r["offset"][0]): r["extent"][0] for r in found} == want and len(found) == len(want) and none == 0


def test_merged_boxes_are_maximal(spark):
    import random

    rng = random.Random(1)
    cells = {(rng.randrange(12), rng.randrange(9)) for _ in range(70)}
    boxes = [(tuple(r["offset"]), tuple(r["extent"])) for r in chunks.written_chunks(spark.createDataFrame([("p", *c) for c in cells], "path string, i0 long, i1 long"), 2).collect()]
    covered = [(i, j) for (a, b), (n, m) in boxes for i in range(a, a + n) for j in range(b, b + m)]
    assert len(covered) == len(set(covered)) and set(covered) == cells
    for (a, b), (n, m) in boxes:
        assert ((a + n, b) not in {o for o, e in boxes if e[1] == m}) and ((a, b + m) not in {o for o, e in boxes if e[0] == n})


def test_extended_component(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "i0 long, i1 long, value double")
    assert chunks.extend(df, [2, 2], [3, 4]).count() == 2
    got = {(r["i0"], r["i1"]): r["value"] for r in chunks.extend(df, [2, 2], [3, 3], "constant", fill=7).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 2.0, **{(i, j): 7.0 for i in range(3) for j in range(3) if i == 2 or j == 2}}
    assert chunks.extend(df.limit(0), [], [2, 2], "empty", "constant", fill=3).count() == 4
    with pytest.raises(ValueError):
        chunks.extend(df, [2, 2], [1, 4])


def test_exact_documents(spark):
    body = b'{"data":{"3":{"meshes":{"a":{"datatype":"ULONG","data":[[18446744073709551615,1]]},"s":{"datatype":"STRING","data":["x","y"]},"z":{"datatype":"LONG","data":[1,null]}}}}}'
    found = {r["path"].split("/")[-1]: r for r in documents.decode(spark.createDataFrame([("f", bytearray(body))], "path string, content binary")).collect()}
    assert found["a"]["exact"] == ["18446744073709551615", "1"] and found["a"]["shape"] == [1, 2]
    assert found["s"]["exact"] == ["x", "y"] and found["s"]["data"] is None and "null" in found["z"]["error"]


def test_aligned_components_have_the_same_places(spark):
    a = spark.createDataFrame([(0, 1.0), (1, None)], "row long, value double")
    assert sorted(tuple(r) for r in particles.align({"x": a, "y": a}, ["row"]).collect()) == [(0, 1.0, 1.0), (1, None, None)]
    for other in ([(0, 1.0), (2, 2.0)], [(0, 1.0), (0, 2.0)]):
        b = spark.createDataFrame(other, "row long, value double")
        with pytest.raises(Exception, match="just one value"):
            particles.align({"x": a, "y": b}, ["row"]).collect()


def test_codec_of_written_files(spark, tmp_path):
    for codec in ("gzip", "zstd", "snappy"):
        path = tmp_path / codec
        series.write(spark.range(10).select(F.lit(0).alias("iteration"), "id"), str(path), "groupBased", codec=codec)
        found = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in path.glob("*.parquet")}
        assert found == {codec.upper()}


def test_block_intensity_is_that_of_the_cells(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, None])], "a array<double>, b array<double>")
    assert df.select(meshes.block_intensity("a", "b").alias("i")).first()["i"] == [10.0, None]
