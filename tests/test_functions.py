import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshframe.functions import arrays, dtypes, slicing, units
from meshframe.functions import attributes as attrs
from meshframe.operators.histograms import bin_index
from meshframe.sources import files

SHAPE = (26, 26, 201)
A = np.arange(np.prod(SHAPE)).reshape(SHAPE)


@pytest.mark.parametrize("key", [np.s_[4:8, 5:7, 9:12], np.s_[4:8, 2:3, -4:], np.s_[..., -4], np.s_[5, 6, :], np.s_[5:6, 6:7, :], np.s_[5], np.s_[4:8], (), np.s_[2:4, ..., 4:6], np.s_[3:300], np.s_[7:3]])
def test_regions_are_numpy_slices(key):
    r = slicing.region(key, SHAPE)
    got = A[tuple(slice(o, o + e) for o, e in zip(r.offset, r.extent, strict=True))]
    assert np.array_equal(np.squeeze(got, axis=tuple(r.dropped)), A[key])


@pytest.mark.parametrize("key", [np.s_[::2], (None,), (26,), (-27,), (1, 2, 3, 4), (2, ..., 4, 5, 6), (..., 1, ...)])
def test_wrong_slices(key):
    with pytest.raises(IndexError):
        slicing.region(key, SHAPE)


def test_hyperslabs():
    assert slicing.hyperslab(SHAPE, [0], [-1]) == slicing.Region((0, 0, 0), SHAPE)
    assert slicing.hyperslab((5,), [2], [-1]).extent == (3,)
    for offset, extent in (([1, 1], [1, 1]), ([0, 0, 0], [27, 1, 1]), ([-1, 0, 0], [1, 1, 1])):
        with pytest.raises(ValueError):
            slicing.hyperslab(SHAPE, offset, extent)


@given(st.integers(0, 500), st.integers(1, 40))
def test_splits_tile(n, parts):
    found = slicing.split(n, parts)
    assert sum(e for _, e in found) == n and all(a + e == b for (a, e), (b, _) in zip(found, found[1:], strict=False))
    assert max(e for _, e in found) - min(e for _, e in found) <= 1


def test_split_axis_and_modes():
    assert slicing.split_axis([2, 5, 3]) == 1 and slicing.split_axis([4, 4]) == 0
    assert slicing.mode_fields(0) == (0, 1) and slicing.mode_fields(2) == (3, 2)


def test_ravel_and_unravel(spark):
    rows = spark.range(24).select("id", *(c.alias(f"i{d}") for d, c in enumerate(arrays.unravel("id", (2, 3, 4)))))
    back = rows.select("id", arrays.ravel(["i0", "i1", "i2"], (2, 3, 4)).alias("n"), "i0", "i1", "i2").orderBy("id").collect()
    assert all(r["n"] == r["id"] and (r["i0"], r["i1"], r["i2"]) == np.unravel_index(r["id"], (2, 3, 4)) for r in back)


def test_units_keep_floats(spark):
    df = spark.sql("SELECT cast(2 as float) f, 3 i, 4.0D d")
    out = units.scale_columns(df, {"f": 0.5, "i": 0.5, "d": 1.0 + 1e-12})
    assert dict(out.dtypes) == {"f": "float", "i": "double", "d": "double"} and tuple(out.first()) == (1.0, 1.5, 4.0)


def test_kinds():
    assert dtypes.same_kind("LONG", "LONGLONG") and not dtypes.same_kind("UINT", "INT") and not dtypes.same_kind("VEC_FLOAT", "FLOAT") and dtypes.same_kind("STRING", "STRING")
    assert dtypes.spark_type("VEC_CDOUBLE") == "array<struct<re:double,im:double>>"
    with pytest.raises(ValueError):
        dtypes.spark_type("QUAD")


def test_histogram_bins_are_numpys(spark):
    values = [0.0, 0.1, 0.3, 0.7, 1.0, -0.1, 1.1, float("nan"), 0.6000000000000001, 0.6] + np.linspace(0, 1, 11).tolist()
    got = spark.createDataFrame([(v,) for v in values], "v double").select(bin_index(F.col("v"), 0.0, 1.0, 10).alias("b")).collect()
    counts = np.bincount([r["b"] for r in got if r["b"] is not None], minlength=10)
    assert counts.tolist() == np.histogram([v for v in values if v == v], 10, (0, 1))[0].tolist()


def test_file_patterns(spark):
    names = [("varying_000000",), ("varying_008000",), ("varying_2000000",), ("data00000100",), ("x",)]
    df = spark.createDataFrame(names, "name string")
    assert {r["iteration"] for r in files.discover(df, "varying_%06T").collect()} == {0, 8000, 2000000}
    assert files.discover(df, "data%07T").count() == 0 and files.discover(df, "data%T").count() == 1 and files.discover(df, "data%08T").count() == 1
    with pytest.raises(ValueError):
        files.checked_padding(files.discover(df, "varying_%T"))
    shown = spark.range(1).select(files.file_name("a", F.lit(5), 6, ".h5").alias("a"), files.file_name("a", F.lit(2000000), 6, "").alias("b"), files.file_format(F.lit("x.toml")).alias("c")).first()
    assert tuple(shown) == ("a000005.h5", "a2000000", "toml")


def test_attribute_conversions(spark):
    rows = [("LONG", "7"), ("CHAR", '"x"'), ("VEC_DOUBLE", "[1,2,3,4,5,6,7]"), ("VEC_INT", "[1,2]"), ("STRING", '"word"'), ("BOOL", "true")]
    df = spark.createDataFrame(rows, "dtype string, value string")
    c = {t: attrs.converted(F.col("value"), F.col("dtype"), t).alias(t) for t in ("long", "double", "string", "array", "array7")}
    got = {r["dtype"] + str(len(r["value"])): r for r in df.select("dtype", "value", *c.values()).collect()}
    assert got["LONG1"]["long"] == 7 and got["LONG1"]["array"] == [7.0] and got["CHAR3"]["long"] == 120 and got["CHAR3"]["string"] == "x"
    assert len(got["VEC_DOUBLE15"]["array7"]) == 7 and got["VEC_INT5"]["array7"] is None and got["VEC_INT5"]["long"] is None and got["STRING6"]["long"] is None and got["BOOL4"]["double"] == 1.0
    with pytest.raises(Exception, match="not convertible"):
        df.select(attrs.strict(F.col("value"), attrs.converted(F.col("value"), F.col("dtype"), "array7"), "array7")).collect()


def test_geometry_and_dimension(spark):
    row = spark.range(1).select(attrs.geometry_string(F.lit("customGeometry")).alias("a"), attrs.geometry_string(F.lit("other:x")).alias("b"), attrs.geometry_kind(F.lit("spherical")).alias("c"), attrs.unit_dimension(F.array(*[F.lit(0.0)] * 7), F.create_map(F.lit("L"), F.lit(1.0), F.lit("M"), F.lit(-3.0))).alias("d")).first()
    assert tuple(row) == ("other:customGeometry", "other:x", "spherical", [1.0, -3.0, 0, 0, 0, 0, 0])
