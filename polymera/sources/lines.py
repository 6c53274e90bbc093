"""Line protocol: measurement,tag=v field=v time, parsed by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEAD = r"^((?:\\.|[^\\, ])+)((?:,(?:\\.|[^\\ ])*)?) +((?:\\.|[^\\=, ])+=(?:\"(?:\\.|[^\"\\])*\"|\\.|[^\\ \"])+)(?: +(-?\d+))?\s*$"
_PAIR = r"((?:\\.|[^\\=, ])+)=(\"(?:\\.|[^\"\\])*\"|(?:\\.|[^\\, \"])*)"


def _unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([, =\\\"])", "$1")


def _pairs(text: Column) -> Column:
    keys, values = F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2))
    return F.map_from_arrays(F.transform(keys, _unescaped), values)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(measurement, tags, fields, ts): tags and raw fields as maps, time in nanoseconds or null.

    Works on batch and streaming DataFrames. Blank lines and comments are left out; lines that do not
    parse have a null measurement and stand in `bad`.
    """
    rows = lines.where((F.trim(F.col(column)) != "") & ~F.trim(F.col(column)).startswith("#"))
    ok = F.col(column).rlike(_HEAD)
    part = lambda i: F.when(ok, F.regexp_extract(column, _HEAD, i))
    return rows.select(
        _unescaped(part(1)).alias("measurement"),
        F.transform_values(_pairs(F.substr(F.concat(part(2), F.lit("")), F.lit(2))), lambda _, v: _unescaped(v)).alias("tags"),
        _pairs(part(3)).alias("fields"),
        F.when(part(4) != "", part(4).cast("long")).alias("ts"),
        F.when(~ok, F.col(column)).alias("bad"),
    )


def field_value(fields: Column, name: str) -> dict[str, Column]:
    """A field's raw text as each type it may have: double, long (1i), boolean and string ("...")."""
    raw = fields[name]
    return {
        "double": F.when(raw.rlike(r"^[-+]?[\d.]+(?:[eE][-+]?\d+)?$"), raw.cast("double")),
        "long": F.when(raw.rlike(r"^[-+]?\d+[iu]$"), F.substring(raw, 1, 40).substr(F.lit(1), F.length(raw) - 1).cast("long")),
        "boolean": F.when(raw.isin("t", "T", "true", "True", "TRUE"), True).when(raw.isin("f", "F", "false", "False", "FALSE"), False),
        "string": F.when(raw.startswith('"'), F.regexp_replace(F.regexp_replace(raw, r'^"|"$', ""), r"\\([\"\\])", "$1")),
    }


def infer_schema(parsed: DataFrame) -> dict[str, str]:
    """Type of each field over all lines: long, boolean or string if all agree, numbers of both kinds are double, else string."""
    raw = parsed.select(F.explode("fields").alias("name", "raw"))
    kind = F.when(F.col("raw").startswith('"'), "string").when(F.col("raw").rlike(r"^[-+]?\d+[iu]$"), "long").when(F.lower("raw").isin("t", "f", "true", "false"), "boolean").when(F.col("raw").rlike(r"^[-+]?[\d.]+(?:[eE][-+]?\d+)?$"), "double").otherwise("string")
    found = raw.groupBy("name").agg(F.collect_set(kind).alias("kinds")).collect()
    return {r["name"]: r["kinds"][0] if len(r["kinds"]) == 1 else "double" if set(r["kinds"]) == {"long", "double"} else "string" for r in found}
