"""Types of components and attributes, their Spark types, and tests of kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, kind, bits, Spark type. Widths are those of 64-bit Linux.
TYPES = [
    ("CHAR", "int", 8, "tinyint"),
    ("SCHAR", "int", 8, "tinyint"),
    ("UCHAR", "uint", 8, "smallint"),
    ("SHORT", "int", 16, "smallint"),
    ("USHORT", "uint", 16, "int"),
    ("INT", "int", 32, "int"),
    ("UINT", "uint", 32, "bigint"),
    ("LONG", "int", 64, "bigint"),
    ("LONGLONG", "int", 64, "bigint"),
    ("ULONG", "uint", 64, "decimal(20,0)"),
    ("ULONGLONG", "uint", 64, "decimal(20,0)"),
    ("FLOAT", "float", 32, "float"),
    ("DOUBLE", "float", 64, "double"),
    ("LONG_DOUBLE", "float", 128, "double"),
    ("CFLOAT", "complex", 64, "struct<re:float,im:float>"),
    ("CDOUBLE", "complex", 128, "struct<re:double,im:double>"),
    ("CLONG_DOUBLE", "complex", 256, "struct<re:double,im:double>"),
    ("STRING", "string", 0, "string"),
    ("BOOL", "bool", 1, "boolean"),
]
_BY_NAME = {name: (kind, bits, spark) for name, kind, bits, spark in TYPES}


def spark_type(dtype: str) -> str:
    """The Spark type of a dtype name; VEC_ and ARR_DBL_7 are arrays; unknown names are an error."""
    if dtype == "ARR_DBL_7":
        return "array<double>"
    if dtype.startswith("VEC_"):
        return f"array<{spark_type(dtype[4:])}>"
    if dtype not in _BY_NAME:
        raise ValueError(f"no type is named {dtype}")
    return _BY_NAME[dtype][2]


def same_kind(a: str, b: str) -> bool:
    """Whether two dtypes agree in kind, signedness, width and in being vectors."""
    if a == b:
        return True
    if a.startswith("VEC_") != b.startswith("VEC_"):
        return False
    x, y = (_BY_NAME.get(d.removeprefix("VEC_")) for d in (a, b))
    return bool(x and y and x[:2] == y[:2] and x[0] in ("int", "uint", "float", "complex"))


def type_table(spark: SparkSession) -> DataFrame:
    """(dtype, kind, bits): a few dozen rows, for joins."""
    rows = [(p + name, kind, bits, bool(p)) for p in ("", "VEC_") for name, kind, bits, _ in TYPES]
    return spark.createDataFrame(rows, "dtype string, kind string, bits int, is_vector boolean")


def same_kind_column(df: DataFrame, a: str, b: str, out: str = "same_kind") -> DataFrame:
    """df with a column that tells if the dtypes in two columns are of one kind; unknown names only match themselves."""
    types = type_table(df.sparkSession)
    for i, c in enumerate((a, b)):
        df = df.join(F.broadcast(types.select(F.col("dtype").alias(c), F.struct("kind", "bits", "is_vector").alias(f"__kind{i}"))), c, "left")
    numeric: Column = F.col("__kind0.kind").isin("int", "uint", "float", "complex")
    return df.withColumn(out, (F.col(a) == F.col(b)) | F.coalesce(numeric & (F.col("__kind0") == F.col("__kind1")), F.lit(False))).drop("__kind0", "__kind1")
