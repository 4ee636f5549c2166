"""Dynamic metadata values: bool, int, float, string or list of strings, each with its kind.

A value is a struct with a `kind` and one filled slot; a chunk's metadata is a map from
field to such a struct. Equality is by kind and value, so that 3, 3.0 and "3" differ.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("l", T.ArrayType(T.StringType())),
    ]
)
METADATA = T.MapType(T.StringType(), VALUE)
SLOTS = {"bool": "b", "int": "i", "float": "f", "string": "s", "list": "l"}
#: What a string must look like to count as a number; Spark's casts alone accept more.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$|^(?i:[+-]?(?:inf|infinity|nan))$"


def kind_of(value: Any) -> str:
    """Kind of a Python value; an integer beyond 64 bits is a float."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int" if -(1 << 63) <= value < 1 << 63 else "float"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
        return "list"
    raise ValueError(f"a metadata value is a bool, int, float, string or list of strings, not {value!r}")


def to_value(value: Any) -> dict[str, Any]:
    kind = kind_of(value)
    out: dict[str, Any] = {"kind": kind, **dict.fromkeys(SLOTS.values())}
    out[SLOTS[kind]] = float(value) if kind == "float" else list(value) if kind == "list" else value
    return out


def to_metadata(fields: dict[str, Any] | None) -> dict[str, dict[str, Any]]:
    return {k: to_value(v) for k, v in (fields or {}).items()}


def from_value(value: Any) -> Any:
    """Python value of a collected struct."""
    if value is None:
        return None
    out = value[SLOTS[value["kind"]]]
    return list(out) if value["kind"] == "list" else out


def from_metadata(fields: Any) -> dict[str, Any] | None:
    return None if fields is None else {k: from_value(v) for k, v in fields.items()}


def value(kind: str, column: Column) -> Column:
    """Struct of a column whose kind is known."""
    slots = [(column if slot == SLOTS[kind] else F.lit(None)).cast(VALUE[slot].dataType).alias(slot) for slot in SLOTS.values()]
    return F.struct(F.lit(kind).alias("kind"), *slots).cast(VALUE)


def metadata_of(**columns: tuple[str, Column]) -> Column:
    """Map from (kind, column) pairs; fields that are null in a row are missing there."""
    entries = [F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), value(kind, c).alias("value"))) for k, (kind, c) in columns.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())).cast(METADATA)


def parse_metadata(json: Column) -> Column:
    """Map from a JSON object; 3 is an int, 3.0 a float, [] an empty list. Other JSON values are an error."""
    return typed(F.from_json(json, "map<string, variant>"))


def typed(fields: Column) -> Column:
    """Map from a map of variants."""

    def one(key: Column, v: Column) -> Column:
        shape = F.schema_of_variant(v)
        number = shape.startswith("DECIMAL") | (shape == "DOUBLE") | (shape == "FLOAT")
        kind = (
            F.when(shape == "BOOLEAN", "bool")
            .when(shape == "BIGINT", "int")
            .when(number, "float")
            .when(shape == "STRING", "string")
            .when(shape.isin("ARRAY<STRING>", "ARRAY<VOID>"), "list")
            .otherwise(F.raise_error(F.concat(F.lit("no metadata value: "), key, F.lit(" is "), F.coalesce(shape, F.lit("null")))))
        )
        slot = lambda k, t: F.when(kind == k, F.try_variant_get(v, "$", t))
        return F.struct(
            kind.alias("kind"), slot("bool", "boolean").alias("b"), slot("int", "bigint").alias("i"), slot("float", "double").alias("f"),
            slot("string", "string").alias("s"), slot("list", "array<string>").alias("l"),
        )

    return F.transform_values(fields, one).cast(METADATA)


def field(name: str, metadata: Column | None = None) -> Column:
    """The struct of a field, null where it is missing."""
    return F.try_element_at(F.col("metadata") if metadata is None else metadata, F.lit(name))


def text_as_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.lower(text).try_cast("double"))


def as_number(v: Column) -> Column:
    """Numeric view: floats, ints, and strings that are numbers; else null."""
    return F.coalesce(v["f"], v["i"].cast("double"), text_as_number(v["s"]))


def float_as_text(x: Column) -> Column:
    """A float without a fraction of 0, and without an exponent while 38 digits hold it."""
    short = F.regexp_replace(x.cast("string"), r"\.0$", "")
    plain = F.regexp_replace(x.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.isnan(x), "NaN")
        .when(F.abs(x) == F.lit(math.inf), F.when(x > 0, "inf").otherwise("-inf"))
        .when((F.floor(x) == x) & (F.abs(x) < 1e18), F.when(F.abs(x) < 1e18, x).cast("bigint").cast("string"))
        .when(~short.contains("E"), short)
        .otherwise(F.coalesce(plain, short))
    )


def as_text(v: Column) -> Column:
    """The text under which facets count a value; a list is one value, joined by commas."""
    return F.coalesce(v["s"], v["i"].cast("string"), v["b"].cast("string"), F.when(v["f"].isNotNull(), float_as_text(v["f"])), F.array_join(v["l"], ","))
