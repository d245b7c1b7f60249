import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from meshframe.functions.slicing import Region, plane
from meshframe.operators import chunks, meshes, patches, spatial
from meshframe.sources import components, layout, tolerant


def generated(df):
    """Rows out of the Generate nodes of a plan that has run, if it has no exchange."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "Generate":
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())] + ([node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.startswith("ResultQueryStage") else [])
    return total


def grid(spark, shape, widths):
    """A field whose cells hold their linear index, in blocks; edge blocks are cut."""
    cells = spark.range(shape[0] * shape[1] * shape[2])
    i = [F.floor(F.col("id") / (shape[1] * shape[2])), F.floor(F.col("id") / shape[2]) % shape[1], F.col("id") % shape[2]]
    cells = cells.select(F.lit(1).cast("long").alias("iteration"), *(x.cast("long").alias(f"i{d}") for d, x in enumerate(i)), F.col("id").alias("value"))
    return meshes.cells_to_blocks(cells, widths, shape)


def test_boxes_make_only_their_own_rows(spark):
    shape = (9, 10, 11)
    blocks = grid(spark, shape, (4, 5, 3)).cache()
    rng = random.Random(3)
    boxes = [plane(shape, d, at) for d, at in ((0, 5), (1, 0), (2, 10))] + [Region((0, 0, 0), shape), Region((2, 3, 1), (0, 4, 4))]
    for _ in range(6):
        offset = [rng.randrange(n) for n in shape]
        boxes.append(Region(tuple(offset), tuple(rng.randint(1, n - o) for n, o in zip(shape, offset))))
    for box in boxes:
        df = meshes.blocks_to_cells(blocks, 3, box=box)
        got = {(r["i0"], r["i1"], r["i2"]): r["value"] for r in df.collect()}
        want = {(i, j, k): (i * shape[1] + j) * shape[2] + k for i in range(box.offset[0], box.offset[0] + box.extent[0]) for j in range(box.offset[1], box.offset[1] + box.extent[1]) for k in range(box.offset[2], box.offset[2] + box.extent[2])}
        assert got == want and generated(df) == len(want)


def test_blocks_without_values_make_no_rows(spark):
    blocks = spark.createDataFrame([(1, [0, 0], [2, 2], None), (1, [2, 0], [1, 2], [5.0, None])], "iteration long, offset array<long>, extent array<long>, values array<double>")
    assert [tuple(r) for r in meshes.blocks_to_cells(blocks, 2, box=Region((0, 0), (3, 2))).orderBy("i1").collect()] == [(1, 2, 0, 5.0), (1, 2, 1, None)]


def boxes(rng, n, rank, whole):
    out = []
    for i in range(n):
        lo = [rng.randint(-40, 40) if whole else rng.uniform(-4, 4) for _ in range(rank)]
        size = [rng.choice((0, 1, 2, 3, 8, 9, 60)) if whole else rng.choice((0.001, 0.1, 1, 5.5)) for _ in range(rank)]
        out.append((rng.choice("ab"), i, lo, [a + b for a, b in zip(lo, size)]))
    return out


@pytest.mark.parametrize(("rank", "whole"), [(1, True), (2, True), (3, True), (2, False), (3, False)])
def test_boxes_meet_once(spark, rank, whole):
    rng, kind = random.Random(rank), "bigint" if whole else "double"
    left, right = boxes(rng, 70, rank, whole), boxes(rng, 60, rank, whole)
    l = spark.createDataFrame(left + [("a", 900, None, None), (None, 901, left[0][2], left[0][3])], f"key string, l int, l_lo array<{kind}>, l_hi array<{kind}>")  # noqa: E741
    r = spark.createDataFrame(right, f"key string, r int, r_lo array<{kind}>, r_hi array<{kind}>")
    found = spatial.meeting(l, r, rank, ["key"])
    assert set(found.columns) == {"key", "l", "r", "l_lo", "l_hi", "r_lo", "r_hi"}
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and all(p < q for p, q in zip(a[2] + b[2], a[3] + b[3])) and all(a[2][d] < b[3][d] and b[2][d] < a[3][d] for d in range(rank)))
    assert sorted((x["l"], x["r"]) for x in found.collect()) == want


def test_many_shapes_take_wider_steps(spark):
    rng = random.Random(9)
    left = [("a", i, [rng.randint(0, 2**30) for _ in range(3)]) for i in range(300)]
    left = [(k, i, lo, [v + 2 ** rng.randint(0, 24) for v in lo]) for k, i, lo in left]
    df = spark.createDataFrame(left, "key string, l int, l_lo array<long>, l_hi array<long>")
    found, step = spatial._levels(df, "l", 3)
    assert step > 1 and len(found) <= spatial.MOST_LEVELS
    right = df.select("key", F.col("l").alias("r"), F.col("l_lo").alias("r_lo"), F.col("l_hi").alias("r_hi"))
    want = sorted((a[1], b[1]) for a in left for b in left if all(a[2][d] < b[3][d] and b[2][d] < a[3][d] for d in range(3)))
    assert sorted((x["l"], x["r"]) for x in spatial.meeting(df, right, 3, ["key"]).collect()) == want


def test_particles_at_positions(spark):
    rng = random.Random(1)
    points = [(1, "e", i, rng.choice([None, float("nan")]) if i % 29 == 0 else rng.choice([0.0, 1.0, 2.5, rng.uniform(-3, 3)]), rng.uniform(-3, 3)) for i in range(400)]
    own = [(1, "e", p, rng.choice([-3.0, -1.0, 0.0, 1.0]), rng.uniform(-3, 2), rng.choice([0.0, 1.0, 2.5, 0.01]), rng.choice([0.5, 4.0])) for p in range(40)]
    particles = spark.createDataFrame(points, "iteration long, species string, row long, x double, y double")
    table = spark.createDataFrame(own, "iteration long, species string, patch_id long, offset_x double, offset_y double, extent_x double, extent_y double")
    got = sorted((r["row"], r["patch_id"]) for r in patches.at_position(particles, table, ["x", "y"], ["x", "y"]).collect())
    assert got == sorted((p[2], b[2]) for p in points for b in own if p[3] is not None and b[3] <= p[3] < b[3] + b[5] and b[4] <= p[4] < b[4] + b[6])
    assert patches.at_position(particles, table.limit(0), ["x"], ["x"]).count() == 0


def test_rebuilt_boxes_cannot_be_joined(spark):
    rng = random.Random(8)
    cells = [("p", i, j, k) for i in range(7) for j in range(6) for k in range(8) if rng.random() < 0.7]
    rows = chunks.written_chunks(spark.createDataFrame(cells * 2, "path string, i0 long, i1 long, i2 long"), 3).collect()
    found = [(tuple(r["offset"]), tuple(r["extent"])) for r in rows]
    covered = [(o[0] + a, o[1] + b, o[2] + c) for o, e in found for a in range(e[0]) for b in range(e[1]) for c in range(e[2])]
    assert sorted(covered) == sorted(c[1:] for c in cells)
    for d in range(3):
        rest = lambda x: x[:d] + x[d + 1 :]  # noqa: B023, E731
        starts = {(o[d], rest(o), rest(e)) for o, e in found}
        assert not any((o[d] + e[d], rest(o), rest(e)) in starts for o, e in found)


def test_planes_open_few_files(spark, tmp_path):
    shape, path = (16, 16, 16), str(tmp_path / "laid")
    layout.write(grid(spark, shape, (2, 2, 2)), path, (2, 2, 2), side=1)
    assert layout.boxes(spark, path).count() == 64 and layout.boxes(spark, path).agg(F.max("blocks")).first()[0] == 8
    for axis in range(3):
        box = plane(shape, axis, 7)
        blocks = layout.read(spark, path, box)
        assert len(blocks.inputFiles()) == 16 and meshes.blocks_to_cells(blocks, 3, box=box).count() == 256
    assert layout.read(spark, path, Region((0, 0, 0), (0, 1, 1))).count() == 0
    layout.write(grid(spark, shape, (2, 2, 2)).withColumn("iteration", F.lit(5).cast("long")), path, (2, 2, 2), side=1, mode="append")
    assert layout.boxes(spark, path).count() == 128 == layout.boxes(spark, path).select("file").distinct().count()
    assert {r[0] for r in layout.read(spark, path, plane(shape, 1, 0), [5]).select("iteration").distinct().collect()} == {5}
    at = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0), (3, 3)], "a long, b long")
    assert [r[0] for r in at.select(layout.z_order([F.col("a"), F.col("b")])).collect()] == [0, 1, 2, 3, 4, 8, 15]


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_components_of_stored_iterations(spark, tmp_path):
    path = str(tmp_path / "run")
    cell = lambda it, v, rows=1: spark.createDataFrame([(it, r, float(v)) for r in range(rows)], "iteration long, row long, value double")
    components.write(cell(0, 0), path, "x", 0, whole=True)
    components.write(cell(0, 0), path, "y", 0, whole=True)
    before = stamps(path)
    components.write(cell(1, 1), path, "x", 1, whole=True)
    components.write(cell(0, 1), path, "y", 1, whole=True)
    after = stamps(path)
    assert {f: after[f] for f in before} == before
    got = {(r["iteration"], r["x"], r["y"]) for r in components.read_together(spark, path, ["x", "y"]).collect()}
    assert got == {(0, 0.0, 1.0), (1, 1.0, None)}
    components.write(cell(1, 3, 4), path, "x", 2, whole=True)
    components.write(cell(1, 5, 2), path, "x", 3, whole=False)
    want = {(0, 0, 0.0), (1, 0, 5.0), (1, 1, 5.0), (1, 2, 3.0), (1, 3, 3.0)}
    read = lambda: {tuple(r) for r in components.read(spark, path, "x").collect()}
    untouched = {f: t for f, t in stamps(path).items() if "/x/iteration=0/" in f or "/y/" in f}
    assert read() == want and components.compacted(spark, path, "x") == [1] and read() == want
    now = stamps(path)
    assert {f: now[f] for f in untouched} == untouched and len([f for f in now if "/x/iteration=1/" in f]) == len([f for f in now if "write_seq=4" in f])
    assert components.compacted(spark, path, "x") == [] and read() == want
    assert {tuple(r) for r in components.read(spark, path, "x", [1]).collect()} == {w for w in want if w[0] == 1}


def test_damaged_files_are_reported(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = spark.range(4000).selectExpr("id % 4 iteration", "id row", "rand(3) x", "cast(rand(4) * 1e9 as string) s")
    rows.repartition("iteration").write.partitionBy("iteration").parquet(path)
    good, bad = tolerant.read(spark, path)
    assert good.count() == 4000 and bad.count() == 0

    def part(k):
        folder = f"{path}/iteration={k}"
        return next(f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part-"))

    cut = part(1)
    with open(cut, "r+b") as f:
        f.truncate(os.path.getsize(cut) // 2)
    os.remove(os.path.join(os.path.dirname(cut), f".{os.path.basename(cut)}.crc"))
    good, bad = tolerant.read(spark, path)
    report = bad.collect()
    assert {r[0] for r in good.select("iteration").distinct().collect()} == {0, 2, 3} and good.count() == 3000
    assert [r["iteration"] for r in report] == [1] and report[0]["file"].endswith(os.path.basename(cut)) and report[0]["error"]
    damaged = part(2)
    with open(damaged, "r+b") as f:  # the footer stays as it is, the data doesn't
        f.seek(8)
        f.write(b"\xff" * (os.path.getsize(damaged) // 3))
    os.remove(os.path.join(os.path.dirname(damaged), f".{os.path.basename(damaged)}.crc"))
    good, bad = tolerant.read(spark, path, deep=True)
    assert {r["iteration"] for r in bad.collect()} == {1, 2} and good.count() == 2000
    for k in (0, 3):
        shutil.rmtree(f"{path}/iteration={k}")
    with pytest.raises(ValueError):
        tolerant.read(spark, path, deep=True)


def broadcasts(df):
    """Whether the plan of df, as it was chosen, holds a side whole."""
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() or "BroadcastNestedLoopJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_boxes_meet_without_a_broadcast(spark):
    side = lambda s: spark.range(50).select(F.lit("a").alias("key"), F.array("id").alias(f"{s}_lo"), F.array(F.col("id") + 4).alias(f"{s}_hi"))
    found = spatial.meeting(side("l"), side("r"), 1, ["key"])
    assert not broadcasts(found) and found.count() == 50 * 7 - 12
    dealt = spatial._dealt(side("l").filter("l_lo[0] % 4 = 0"), "l", 1, 1, [(2,)], [(2,)])
    assert [r["l_cell0"] for r in dealt.orderBy("l_cell0").collect()] == list(range(12 + 1))  # 0 to 48: each is in a single cell
