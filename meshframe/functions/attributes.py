"""Attributes of nodes: long tables of (iteration, path, name, dtype, value as JSON text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: known geometries, the order of the seven powers, defaults of missing metadata, and what is written by itself.
GEOMETRIES = ("cartesian", "thetaMode", "cylindrical", "spherical", "other")
POWERS = ("L", "M", "T", "I", "theta", "N", "J")
DEFAULTS = {"geometry": '"cartesian"', "dataOrder": '"C"', "axisLabels": '["x"]', "gridSpacing": "[1.0]", "gridGlobalOffset": "[0.0]", "gridUnitSI": "1.0", "unitSI": "1.0", "position": "[0.0]", "time": "0.0", "dt": "1.0", "timeUnitSI": "1.0"}
WRITTEN = {"series": ("basePath", "iterationEncoding", "iterationFormat"), "iteration": ("snapshot",), "constant": ("value", "shape")}


def wide(attributes: DataFrame, names: list[str]) -> DataFrame:
    """A row for each node, a column for each of the names."""
    return attributes.groupBy("iteration", "path").pivot("name", names).agg(F.first("value"))


#: The bounds of narrow integers.
NARROW = {"byte": 7, "ubyte": 8, "short": 15, "ushort": 16, "int": 31, "uint": 32}


def _complex(pair: Column) -> Column:
    """(re, im) of an array of two numbers; null for others."""
    return F.when((F.size(pair) == 2) & ~F.exists(pair, lambda x: x.isNull()), F.struct(F.get(pair, 0).alias("re"), F.get(pair, 1).alias("im")))


def converted(value: Column, dtype: Column, to: str) -> Column:
    """The value as a double, long, ulong (a decimal of 20 places), string, or array of doubles, longs or strings; null if it can't be converted.

    Numbers become each other, integers exactly; a string of one character its code and back; a scalar is an array of one;
    an array of one stays an array. `array7` is an array of exactly seven doubles, `long_array` and `string_array` have integers and texts. `byte`, `ubyte`, `short`,
    `ushort`, `int` and `uint` are longs that fit, else null; `bool` is whether a number isn't 0; `char` is a text of one character, or that of a code;
    `complex` is (re, im) of a complex or a real number, `complex_array` an array of them, `bool_array` one of truth values. Complex numbers become nothing else.
    """
    if to in NARROW:
        low = 0 if to[0] == "u" else -(1 << NARROW[to])
        own = converted(value, dtype, "long")
        return F.when(own.between(low, (1 << NARROW[to]) - 1), own)
    if to == "bool":
        return converted(value, dtype, "double") != 0
    if to == "char":
        own = F.when(dtype.isin("STRING", "CHAR"), converted(value, dtype, "string")).otherwise(F.char(converted(value, dtype, "ubyte")))
        return F.when(F.char_length(own) == 1, own)
    if to == "complex":
        real = converted(value, dtype, "double")
        return F.when(dtype.isin("CFLOAT", "CDOUBLE", "CLONG_DOUBLE"), _complex(F.from_json(value, "array<double>"))).when(real.isNotNull(), F.struct(real.alias("re"), F.lit(0.0).alias("im")))
    if to == "complex_array":
        pairs = F.transform(F.from_json(value, "array<array<double>>"), _complex)
        reals = F.transform(converted(value, dtype, "array"), lambda x: F.struct(x.alias("re"), F.lit(0.0).alias("im")))
        one = converted(value, dtype, "complex")
        own = F.when(dtype.isin("VEC_CFLOAT", "VEC_CDOUBLE", "VEC_CLONG_DOUBLE"), pairs).when(dtype.startswith("VEC_") | dtype.startswith("ARR_"), reals).when(one.isNotNull(), F.array(one))
        return F.when(~F.exists(own, lambda x: x.isNull()), own)
    if to == "bool_array":
        flags = F.when(dtype == "VEC_BOOL", F.from_json(value, "array<boolean>")).when(dtype == "BOOL", F.array(converted(value, dtype, "bool"))).otherwise(F.transform(converted(value, dtype, "array"), lambda x: x != 0))
        return F.when(~F.exists(flags, lambda x: x.isNull()), flags)
    is_vector = dtype.startswith("VEC_") | dtype.startswith("ARR_")
    is_text = dtype.isin("STRING", "CHAR")
    text = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    code = F.when(F.char_length(text) == 1, F.ascii(text))
    if to in ("long", "ulong", "double"):
        kind = "decimal(20,0)" if to == "ulong" else to
        own = text.try_cast("double")
        if to != "double":  # whole numbers exactly; others lose their fraction
            own = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(kind)).otherwise(own.try_cast("long").cast(kind))
        own = F.when(dtype == "BOOL", text.try_cast("boolean").cast("int").cast(kind)).otherwise(own)
        return F.when(is_vector, None).when(is_text, code.cast(kind)).otherwise(own)
    if to == "string":
        return F.when(is_vector, None).when(is_text, text).when(text.try_cast("double").isNotNull(), F.char(text.try_cast("int")))
    if to in ("long_array", "string_array"):
        texts = F.when(is_vector, F.from_json(value, "array<string>")).otherwise(F.array(text))
        own = F.transform(texts, lambda x: x.try_cast("long")) if to == "long_array" else texts
        return F.when(~F.exists(own, lambda x: x.isNull()), own)
    array = F.when(is_vector, F.from_json(value, "array<double>")).otherwise(F.array(F.when(is_text, code).otherwise(text.try_cast("double")).cast("double")))
    array = F.when(~F.exists(array, lambda x: x.isNull()), array)
    return F.when(F.size(array) == 7, array) if to == "array7" else array


def strict(value: Column, found: Column, to: str) -> Column:
    """found, or an error where value couldn't be converted."""
    return F.when(value.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit(f"not convertible to {to}: "), value))).otherwise(found)


def upserted(attributes: DataFrame, new: DataFrame) -> DataFrame:
    """The attributes with those of new set or overwritten."""
    keys = ["iteration", "path", "name"]
    return attributes.join(new.select(*keys), keys, "left_anti").unionByName(new)


def deleted(attributes: DataFrame, gone: DataFrame) -> DataFrame:
    """The attributes without the (iteration, path, name) of gone."""
    return attributes.join(gone.select("iteration", "path", "name"), ["iteration", "path", "name"], "left_anti")


def copied(attributes: DataFrame, version_attribute: str | None, node_type: str = "node_type") -> DataFrame:
    """What a copy takes over: all but the attributes that the writer makes by itself, and the one of the series that names the format's version (None: there is no such one)."""
    own = reduce(lambda a, b: a | b, ((F.col(node_type) == t) & F.col("name").isin(*names) for t, names in WRITTEN.items()))
    if version_attribute is not None:
        own = own | (F.col(node_type) == "series") & (F.col("name") == version_attribute)
    return attributes.filter(~F.coalesce(own, F.lit(False)))


def unit_dimension(base: Column, powers: Column) -> Column:
    """Seven powers: those of a map by name over the ones of base; missing ones are 0."""
    own = [F.coalesce(F.try_element_at(powers, F.lit(p)), F.get(base, i), F.lit(0.0)).cast("double") for i, p in enumerate(POWERS)]
    return F.array(*own)


def geometry_string(geometry: Column) -> Column:
    """Unknown geometries under the prefix other:, once."""
    return F.when(geometry.isin(*GEOMETRIES) | geometry.startswith("other:"), geometry).otherwise(F.concat(F.lit("other:"), geometry))


def geometry_kind(geometry: Column) -> Column:
    return F.when(geometry.isin(*GEOMETRIES), geometry).otherwise(F.lit("other"))


def with_defaults(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Wide nodes with the format's defaults for missing values."""
    return nodes.withColumns({n: F.coalesce(n, F.lit(DEFAULTS[n])) for n in names if n in nodes.columns})


def default_dimension(record: Column) -> Column:
    """Powers of a record without any: a length for positions."""
    return F.when(record.isin("position", "positionOffset"), F.array(*map(F.lit, [1.0] + [0.0] * 6))).otherwise(F.array(*map(F.lit, [0.0] * 7)))


#: Fixed values of the format: the attributes that each type of node must have, and what they convert to.
REQUIRED = {
    "series": {"basePath": "string", "iterationEncoding": "string", "iterationFormat": "string"},
    "iteration": {"time": "double", "dt": "double", "timeUnitSI": "double"},
    "mesh": {"geometry": "string", "dataOrder": "char", "axisLabels": "string_array", "gridSpacing": "array", "gridGlobalOffset": "array", "gridUnitSI": "double", "unitDimension": "array7", "timeOffset": "double"},
    "record": {"unitDimension": "array7", "timeOffset": "double"},
    "component": {"unitSI": "double"},
    "mesh_component": {"unitSI": "double", "position": "array"},
}


def required_violations(nodes: DataFrame, attributes: DataFrame, required: dict[str, dict[str, str]] = REQUIRED) -> DataFrame:
    """(iteration, path, node_type, name, problem): what nodes (iteration, path, node_type) lack or have in another type.

    Nodes without any attribute count too; those of types that are not in required need nothing.
    """
    pairs = [F.struct(F.lit(t).alias("node_type"), F.lit(n).alias("name"), F.lit(to).alias("to")) for t, own in required.items() for n, to in own.items()]
    wanted = nodes.select("iteration", "path", "node_type", F.explode(F.filter(F.array(*pairs), lambda x: x["node_type"] == F.col("node_type"))).alias("__w"))
    wanted = wanted.select("iteration", "path", "node_type", "__w.name", "__w.to")
    both = wanted.join(attributes.select("iteration", "path", "name", "dtype", "value"), ["iteration", "path", "name"], "left")
    fits = F.lit(False)
    for to in sorted({to for own in required.values() for to in own.values()}):
        fits = fits | ((F.col("to") == to) & converted(F.col("value"), F.col("dtype"), to).isNotNull())
    problem = F.when(F.col("value").isNull(), "missing").when(~fits, "type")
    return both.select("iteration", "path", "node_type", "name", problem.alias("problem")).filter("problem is not null")


#: Fixed values of the format: the children that each type of node must have.
REQUIRED_CHILDREN = {"species": ("position", "positionOffset"), "patches": ("numParticles", "numParticlesOffset", "offset", "extent")}


def missing_children(nodes: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED_CHILDREN) -> DataFrame:
    """(iteration, path, node_type, name): records that species and patches must have and don't; nodes has (iteration, path, node_type), a row for each node."""
    pairs = [F.struct(F.lit(t).alias("node_type"), F.lit(n).alias("name")) for t, own in required.items() for n in own]
    wanted = nodes.select("iteration", "path", "node_type", F.explode(F.filter(F.array(*pairs), lambda x: x["node_type"] == F.col("node_type"))["name"]).alias("name"))
    child = F.concat(F.rtrim(F.col("path"), F.lit("/")), F.lit("/"), "name")
    # only nodes of such names count; not made distinct, as a scan's task would hold all of them, and merged, as Spark may take the side for a small one
    named = F.substring_index("path", "/", -1).isin(*sorted({n for own in required.values() for n in own}))
    have = nodes.filter(named).select("iteration", F.col("path").alias("__child")).hint("merge")
    return wanted.withColumn("__child", child).join(have, ["iteration", "__child"], "left_anti").select("iteration", "path", "node_type", "name")


def violations(attributes: DataFrame, required: dict[str, str]) -> DataFrame:
    """(iteration, path, name, problem): required attributes that are missing or not of their type, by node."""
    nodes = attributes.select("iteration", "path").distinct()
    wanted = nodes.select("iteration", "path", F.explode(F.create_map(*(F.lit(x) for kv in required.items() for x in kv))).alias("name", "to"))
    both = wanted.join(attributes.select("iteration", "path", "name", "dtype", "value"), ["iteration", "path", "name"], "left")
    fits = F.lit(False)
    for to in sorted(set(required.values())):
        fits = fits | ((F.col("to") == to) & converted(F.col("value"), F.col("dtype"), to).isNotNull())
    problem = F.when(F.col("value").isNull(), "missing").when(~fits, "type")
    return both.select("iteration", "path", "name", problem.alias("problem")).filter("problem is not null")
