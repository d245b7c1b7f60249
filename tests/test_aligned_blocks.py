import random

import pytest
from pyspark.sql import functions as F

from meshframe.functions import attributes as attrs
from meshframe.operators import meshes

BLOCK = "iteration long, offset array<long>, extent array<long>, values array<double>"


def chunked(rng, shape, iteration, sign):
    """A field of linear indices (times sign) in chunks cut at random along each axis."""
    cuts = [sorted({0, n, *(rng.randrange(n) for _ in range(2))}) for n in shape]
    rows = []
    for a, b in zip(cuts[0], cuts[0][1:]):
        for c, d in zip(cuts[1], cuts[1][1:]):
            for e, f in zip(cuts[2], cuts[2][1:]):
                rows.append((iteration, [a, c, e], [b - a, d - c, f - e], [sign * float((i * shape[1] + j) * shape[2] + k) for i in range(a, b) for j in range(c, d) for k in range(e, f)]))
    return rows


def test_components_of_other_chunks_meet_block_by_block(spark):
    rng, shape = random.Random(4), (7, 6, 9)
    x, y, z = ([r for it in (0, 1) for r in chunked(rng, shape, it, s)] for s in (1, -1, 2))
    tables = {n: spark.createDataFrame(r, BLOCK).repartition(3) for n, r in zip("xyz", (x, y, z))}
    got = meshes.aligned_blocks(tables, 3).collect()
    assert all(len(r["x"]) == len(r["y"]) == len(r["z"]) and [-v for v in r["y"]] == r["x"] and [v / 2 for v in r["z"]] == r["x"] for r in got)
    cells = sorted((r["iteration"], v) for r in got for v in r["x"])
    assert cells == sorted((it, float(v)) for it in (0, 1) for v in range(7 * 6 * 9))
    assert len(got) < len(cells) / 3 and meshes.aligned_blocks({n: t.limit(0) for n, t in tables.items()}, 3).count() == 0
    with pytest.raises(Exception, match="no values at"):
        meshes.aligned_blocks({"x": tables["x"], "y": tables["y"].filter("offset[0] = 0")}, 3).collect()


def test_blocks_meet_just_the_edges_inside_them(spark):
    rows = lambda n, h: spark.createDataFrame([(0, [i, 0], [h, 2], [float(i + j // 2) for j in range(2 * h)]) for i in range(0, n, h)], BLOCK)
    tables = {"x": rows(60, 1), "y": rows(60, 4), "z": rows(60, 60)}
    cuts = meshes._edges_inside(tables, 2, ["iteration"], "values").collect()
    assert sorted((r["extent"][0], len(r["at"][0] or ())) for r in cuts) == [(1, 0)] * 60 + [(4, 3)] * 15 + [(60, 59)]
    got = meshes.aligned_blocks(tables, 2).collect()
    assert len(got) == 60 and all(r["x"] == r["y"] == r["z"] == [float(r["offset"][0])] * 2 for r in got)


def test_types_that_attributes_become(spark):
    rows = [("1", "INT"), ("300", "UINT"), ("-1", "LONG"), ('"c"', "CHAR"), ('"word"', "STRING"), ("true", "BOOL"), ("[1.5, -2.0]", "CDOUBLE"), ("[[1, 2], [3, 4]]", "VEC_CFLOAT"), ("[0, 7]", "VEC_INT"), ("[true, false]", "VEC_BOOL"), ("0.0", "DOUBLE"), (None, "INT"), ("[[1]]", "VEC_CDOUBLE")]
    df = spark.createDataFrame(rows, "value string, dtype string")
    kinds = ("byte", "ubyte", "ushort", "bool", "char", "complex", "complex_array", "bool_array")
    got = df.select(*(attrs.converted(F.col("value"), F.col("dtype"), t).alias(t) for t in kinds)).collect()
    pair = lambda re, im: (float(re), float(im))
    plain = [[None if r[k] is None else tuple(r[k]) if k == "complex" else [tuple(v) if k == "complex_array" else v for v in r[k]] if isinstance(r[k], list) else r[k] for k in kinds] for r in got]
    assert plain == [
        [1, 1, 1, True, "\x01", pair(1, 0), [pair(1, 0)], [True]], [None, None, 300, True, None, pair(300, 0), [pair(300, 0)], [True]], [-1, None, None, True, None, pair(-1, 0), [pair(-1, 0)], [True]],
        [99, 99, 99, True, "c", pair(99, 0), [pair(99, 0)], [True]], [None] * 8, [1, 1, 1, True, "\x01", pair(1, 0), [pair(1, 0)], [True]], [None] * 5 + [pair(1.5, -2), [pair(1.5, -2)], None],
        [None] * 6 + [[pair(1, 2), pair(3, 4)], None], [None] * 6 + [[pair(0, 0), pair(7, 0)], [False, True]], [None] * 7 + [[True, False]], [0, 0, 0, False, "\x00", pair(0, 0), [pair(0, 0)], [False]], [None] * 8, [None] * 8,
    ]


def test_children_that_nodes_lack(spark):
    rows = [(1, "/p/e", "species"), (1, "/p/e/position", "record"), (1, "/p/f/", "species"), (1, "/p/f/position", "record"), (1, "/p/f/positionOffset", "record"), (2, "/p/e", "species"), (2, "/p/e/patches", "patches"), (2, "/p/e/patches/offset", "record"), (2, "/m", "mesh")]
    got = attrs.missing_children(spark.createDataFrame(rows, "iteration long, path string, node_type string")).collect()
    assert sorted((r["iteration"], r["path"], r["name"]) for r in got) == [(1, "/p/e", "positionOffset"), (2, "/p/e", "position"), (2, "/p/e", "positionOffset"), *((2, "/p/e/patches", n) for n in ("extent", "numParticles", "numParticlesOffset"))]


def test_made_series_follow_a_table_of_extents(spark, monkeypatch):
    from meshframe.jobs import generate

    monkeypatch.setattr(generate, "RUN", 7)
    extents = spark.createDataFrame([(3, 20), (1, 7), (2, 0), (9, 1)], "block long, cells long")
    assert sorted((r["iteration"], r["block"], r["i"]) for r in generate.fields_of(extents, 2).collect()) == sorted((s, b, i) for s in (0, 1) for b, n in ((3, 20), (1, 7), (9, 1)) for i in range(n))
    rows = sorted((r["block"], r["row"]) for r in generate.particles_of(extents, 1).collect())
    assert rows == [*((1, i) for i in range(7)), *((3, 7 + i) for i in range(20)), (9, 27)]
    values = [r["value"] for r in generate.random_integers_of(extents, 50).collect()]
    assert len(values) == 28 and all(0 <= v <= 50 for v in values) and len(set(values)) > 10
