"""Names of the files of a series: patterns with an iteration number, and its padding."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an extension stands for.
FORMATS = {"json": "json", "toml": "toml", "h5": "hdf5", "bp": "adios2", "bp4": "adios2", "bp5": "adios2", "sst": "adios2", "ssc": "adios2", "parquet": "parquet"}


def pattern_regex(pattern: str) -> str:
    """A regular expression for names of a pattern: %T digits, %0NT padded to N, .%E any extension. Group 1 has the digits."""
    found = re.fullmatch(r"(.*?)%(?:0(\d+))?T(.*?)(\.%E)?", pattern, re.S)
    if not found:
        raise ValueError(f"no %T in {pattern}")
    before, width, after, any_extension = found.groups()
    n = int(width or 0)
    digits = rf"[0-9]{{{n}}}|[1-9][0-9]{{{n},}}" if n > 1 else "[0-9]+"
    return f"^{re.escape(before)}({digits}){re.escape(after)}" + (r"\.[^.]+$" if any_extension else "$")


def discover(names: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """The names that match, with their iteration and the digits as written."""
    regex = pattern_regex(pattern)
    digits = F.regexp_extract(column, regex, 1)
    return names.filter(F.col(column).rlike(regex)).withColumns({"digits": digits, "iteration": digits.cast("long")})


def padding(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, widths, padding): how many digit counts there are, and the one if all agree; null if they don't."""
    n = F.char_length("digits")
    return found.groupBy(*keys).agg(F.count_distinct(n).alias("widths"), F.when(F.min(n) == F.max(n), F.min(n)).alias("padding"))


def checked_padding(found: DataFrame) -> int | None:
    """The padding of a series that is to be written; None for no files, ValueError if it is inconsistent."""
    row = padding(found).first()
    if row["widths"] > 1:
        raise ValueError("files of different numbers of digits")
    return row["padding"]


def file_name(prefix: str, iteration: Column | str, width: int, suffix: str) -> Column:
    """prefix, the iteration padded with zeros to the width (longer ones whole), suffix."""
    digits = (F.col(iteration) if isinstance(iteration, str) else iteration).cast("string")
    padded = F.when(F.char_length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.lit(prefix), padded, F.lit(suffix))


def file_format(name: Column | str) -> Column:
    """The format that a name's extension stands for; null if unknown."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = F.lit(None).cast("string")
    for e, f in FORMATS.items():
        out = F.when(extension == e, f).otherwise(out)
    return out
