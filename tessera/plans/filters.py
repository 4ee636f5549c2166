"""Filters: a mapping of fields to conditions becomes one Boolean column.

A plain value asks for equality of kind and value. A condition mapping may hold `gte` and
`lte` (inclusive, on the numeric view), `contains` (an element of a list, or a string equal
to it) and `in` (strings only); its parts, and the fields, are all required. A missing field
meets no condition. Fields declared as promoted are typed columns of their own, so that
their predicates reach the Parquet scan; the rest are read from the metadata map.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import metavalue as M

PARTS = {"gte", "lte", "contains", "in"}


class Fields:
    """Where a filter finds its fields: promoted {field: (kind, column name)}, then the metadata map."""

    def __init__(self, promoted: Mapping[str, tuple[str, str]] | None = None, metadata: str | None = "metadata"):
        self.promoted = {"doc_type": ("string", "doc_type")} if promoted is None else dict(promoted)
        self.metadata = metadata

    def _slot(self, name: str, kind: str) -> Column | None:
        """The field's value if its kind is `kind`; None if it can never be."""
        if name in self.promoted:
            own, column = self.promoted[name]
            return F.col(column) if own == kind else None
        if self.metadata is None:
            return None
        return M.field(name, F.col(self.metadata))[M.SLOTS[kind]]

    def equals(self, name: str, value: Any) -> Column:
        kind = M.kind_of(value)
        slot = self._slot(name, kind)
        if slot is None:
            return F.lit(False)
        if kind == "list":
            wanted = F.array(*map(F.lit, value)) if value else F.array().cast("array<string>")
            return slot == wanted
        return slot == F.lit(float(value) if kind == "float" else value)

    def number(self, name: str) -> Column | None:
        if name in self.promoted:
            kind, column = self.promoted[name]
            c = F.col(column)
            return {"int": c, "float": c, "string": M.text_as_number(c)}.get(kind)
        return None if self.metadata is None else M.as_number(M.field(name, F.col(self.metadata)))

    def text(self, name: str) -> Column | None:
        return self._slot(name, "string")

    def items(self, name: str) -> Column | None:
        return self._slot(name, "list")


def _range(fields: Fields, name: str, gte: float | None, lte: float | None) -> Column:
    x = fields.number(name)
    if x is None:
        return F.lit(False)
    checks = []
    for bound, op in ((gte, "__ge__"), (lte, "__le__")):
        if bound is not None:
            if isinstance(bound, bool) or not isinstance(bound, (int, float)):
                raise ValueError(f"a bound of {name} is a number, not {bound!r}")
            checks.append(getattr(x, op)(F.lit(bound)))
    if name not in fields.promoted or fields.promoted[name][0] != "int":
        checks.append(~F.isnan(x))  # Spark sorts NaN above all numbers
    return reduce(Column.__and__, checks)


def _condition(fields: Fields, name: str, part: Mapping[str, Any], strict_contains: bool) -> Column:
    unknown = set(part) - PARTS
    if unknown or not any(v is not None for v in part.values()):
        raise ValueError(f"condition of {name} needs some of {sorted(PARTS)}, and has {sorted(part)}")
    found = []
    if part.get("gte") is not None or part.get("lte") is not None:
        found.append(_range(fields, name, part.get("gte"), part.get("lte")))
    if (wanted := part.get("contains")) is not None:
        items, text = fields.items(name), fields.text(name)
        ways = [] if items is None else [F.array_contains(items, F.lit(wanted))]
        if not strict_contains and text is not None:
            ways.append(text == F.lit(wanted))
        found.append(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), ways) if ways else F.lit(False))
    if (wanted := part.get("in")) is not None:
        text = fields.text(name)
        strings = [w for w in wanted if isinstance(w, str)]
        found.append(text.isin(strings) if text is not None and strings else F.lit(False))
    return reduce(Column.__and__, found)


def compile_filters(filters: Mapping[str, Any] | None, fields: Fields | None = None, strict_contains: bool = False) -> Column | None:
    """The column that is true for rows meeting all conditions; None if there are none."""
    fields = fields or Fields()
    parts = [_condition(fields, k, v, strict_contains) if isinstance(v, Mapping) else fields.equals(k, v) for k, v in (filters or {}).items()]
    return reduce(Column.__and__, parts) if parts else None


def eligible(rows: DataFrame, condition: Column | None) -> DataFrame:
    return rows if condition is None else rows.where(condition)


def selectivity(rows: DataFrame, condition: Column | None) -> DataFrame:
    """(eligible, universe, selectivity); an empty universe has selectivity 1."""
    met = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    out = rows.agg(F.count_if(met).alias("eligible"), F.count(F.lit(1)).alias("universe"))
    return out.withColumn("selectivity", F.when(F.col("universe") == 0, F.lit(1.0)).otherwise(F.col("eligible") / F.col("universe")))
