"""Faults that showed on larger tables only, on small tables that have what made them."""

import pyarrow as pa
from pyspark.sql import functions as F

from meshframe.functions import attributes as attrs
from meshframe.functions.slicing import Region
from meshframe.jobs import grid_queries, queries
from meshframe.operators import patches, spatial
from meshframe.sources import documents, layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def part(tmp_path, rows):
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"p_partkey": pa.array([r[0] for r in rows], pa.int64()), "p_size": pa.array([r[1] for r in rows], pa.int32())}), str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_boxes_of_a_grid_are_dealt_once(spark):
    box = lambda s: spark.range(8).select(F.array(*((F.floor(F.col("id") / n) % 2 * 4) for n in (4, 2, 1))).alias(f"{s}_lo")).withColumn(f"{s}_hi", F.transform(f"{s}_lo", lambda x: x + 4))
    assert spatial._dealt(box("r"), "r", 3, 1, [(2, 2, 2)], [(1, 2, 0)]).count() == 8
    found = spatial.meeting(box("l"), box("r"), 3)
    assert found.count() == 8 and "Broadcast" not in plan(found)


def test_boxes_of_parts_meet_chunks_without_a_broadcast(spark, tmp_path):
    import pyarrow.parquet as pq

    keys, vectors = range(60), 40
    at, n = part(tmp_path, [(k, k % 50) for k in keys]), ((vectors - 1) // 16 + 1) * 4
    pq.write_table(pa.table({"vec_id": pa.array(range(vectors), pa.int64()), "label": pa.array([k % 3 for k in range(vectors)], pa.int32()), "embedding": pa.array([[0.5]] * vectors, pa.list_(pa.float32()))}), f"{at}/embeddings.parquet")
    found = grid_queries.d4_overlap_3d(spark, at)
    assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)
    want = []
    for k in keys:
        box = list(zip((k * 3 % n, k * 7 % 14, k * 5 % 15), (1 + k % 50 % 9, 1 + k % 7, 1 + k % 50 % 3), strict=True))
        for v in range(vectors):
            both = [(max(o, b), min(o + e, b + 4)) for (o, e), b in zip(box, (v // 16 * 4, v // 4 % 4 * 4, v % 4 * 4), strict=True)]
            if all(lo < hi for lo, hi in both):
                want.append((k, v % 3, *(lo for lo, _ in both), *(hi - lo for lo, hi in both)))
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100


def test_made_cells_are_not_broadcast(spark, tmp_path):
    found = grid_queries.k4_random_of_extents(spark, part(tmp_path, [(k, k % 4) for k in range(9)]))
    assert "Broadcast" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(k, k % 4, k % 4, True) for k in range(9) if k % 4]


def test_chunks_are_sorted_by_size_whatever_their_keys(spark, tmp_path):
    rows = [(3_000_000, 1), (5, 2), (2_999_999, 2), (-7, 1), (6, 1)]
    found = queries.g5_sorted_chunks(spark, part(tmp_path, rows)).orderBy("n").collect()
    assert [(r["o0"], r["path"], r["n"]) for r in found] == [(s, k, n + 1) for n, (s, k) in enumerate(sorted((s, k) for k, s in rows))]


def test_particles_of_one_place_and_boxes_of_one_shape_meet_once(spark, monkeypatch):
    particles = spark.range(3000).selectExpr("cast(1 as bigint) iteration", "id", "cast(id % 3 as double) x")
    boxes = spark.range(200).selectExpr("cast(1 as bigint) iteration", "id patch_id", "cast(id % 2 as double) offset_x", "2.0D extent_x").unionByName(spark.sql("SELECT 1L iteration, 200L patch_id, 50.0D offset_x, 1.0D extent_x"))
    pairs, at_position = [], patches.at_position
    monkeypatch.setattr(patches, "at_position", lambda *a: pairs.append(at_position(*a)) or pairs[0])
    got = patches.totals_at_position(particles, boxes, ["x"], ["x"], {"ids": "id"}, ["iteration"]).collect()
    ids = lambda lo: sum(i for i in range(3000) if lo <= i % 3 < lo + 2)
    assert sorted((r["patch_id"], r["n"], r["ids"]) for r in got) == [(k, 2000, ids(k % 2)) for k in range(200)]
    assert pairs[0].count() == 4


def test_lacking_records_hold_no_side(spark):
    rows = [(1, "/particles/e", "species"), (1, "/particles/e/position", "record"), (1, "/particles/e/position", "record"), (2, "/particles/e/", "species"), (2, "/particles/e/positionOffset", "record")]
    found = attrs.missing_children(spark.createDataFrame(rows, "iteration long, path string, node_type string"))
    assert "Broadcast" not in plan(found) and "HashAggregate" not in plan(found)
    assert sorted((r["iteration"], r["name"]) for r in found.collect()) == [(1, "positionOffset"), (2, "position")]


def test_many_documents_are_one_batch():
    n = 3 * documents.ROWS
    body = b'{"data":{"0":{"meshes":{"rho":{"datatype":"DOUBLE","data":[1.5,null]}}}}}'
    files = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([body] * n, pa.binary())], ["path", "content"])
    batches = list(documents._decode(iter([files.slice(0, 5), files.slice(5)]), False))
    assert [b.num_rows for b in batches] == [documents.ROWS] * 3
    assert [f for b in batches for f in b.column(0).to_pylist()] == [str(i) for i in range(n)]


def test_numbers_beyond_doubles_are_a_reported_part(spark):
    body = '{"data":{"0":{"meshes":{"n":{"datatype":"LONG","data":[1' + "0" * 400 + ']},"x":{"datatype":"DOUBLE","data":[2.5,null]}}}}}'
    found = {r["path"]: r for r in documents.decode(spark.createDataFrame([("f", bytearray(body.encode()))], "path string, content binary")).collect()}
    assert found["/data/0/meshes/n"]["error"] and found["/data/0/meshes/x"]["data"][0] == 2.5 and found["/data/0/meshes/x"]["data"][1] != found["/data/0/meshes/x"]["data"][1]


def test_many_files_are_opened_by_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "laid")
    blocks = spark.range(64).select((F.col("id") % 2).alias("iteration"), F.array(F.col("id") * 2, F.lit(0).cast("long")).alias("offset"), F.array(*(F.lit(2).cast("long"),) * 2).alias("extent"), F.array(*(F.col("id").cast("float"),) * 4).alias("values"))
    layout.write(blocks, path, (2, 2), side=1)
    box = Region((0, 0), (100, 1))
    rows = lambda: sorted(map(tuple, layout.read(spark, path, box).select("iteration", "offset", "extent", "values").collect()))
    named, files = rows(), layout.crossing(spark, path, box).count()
    monkeypatch.setattr(layout, "NAMED", 5)
    assert rows() == named and "MapInArrow" in plan(layout.read(spark, path, box)) and len(named) >= 50 and files == 50
    assert layout.read(spark, path, Region((0, 0), (0, 1))).count() == 0
