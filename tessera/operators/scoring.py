"""Query-time scores: recency, metadata and relationship factors multiply the base score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.filters import Fields

#: A time stamp must have a time and an offset to count.
STAMP = r"^\s*[+-]?\d{4,6}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?\s*([Zz]|UTC|[+-]\d{2}:?\d{2})\s*$"
PRESETS = {"recent": (7.0, 0.2), "mild": (30.0, 0.3), "aggressive": (3.0, 0.05), "archive": (90.0, 0.5)}


@dataclass(frozen=True)
class Recency:
    field: str
    half_life_days: float
    min_score: float = 0.1

    def __post_init__(self) -> None:
        if self.half_life_days <= 0:
            raise ValueError("half_life_days must be above 0")

    @staticmethod
    def preset(name: str | None, field: str | None) -> Recency | None:
        """None for an unknown name or without a field."""
        return Recency(field, *PRESETS[name]) if name in PRESETS and field else None


@dataclass(frozen=True)
class Boost:
    field: str
    value: str | None = None
    gte: float | None = None
    lte: float | None = None
    weight: float = 1.0


@dataclass(frozen=True)
class RelationshipBoost:
    parent_weight: float = 0.3
    sibling_weight: float = 0.1
    mode: str = "max"


def stamp(text: Column) -> Column:
    """Time of a text with an offset; null for anything else."""
    clean = F.regexp_replace(F.upper(F.trim(text)), r"\s*UTC$", "Z")
    return F.when(text.rlike(STAMP), F.regexp_replace(clean, r"\s+(?=[Z+\-]|$)", "").try_cast("timestamp"))


def decay(at: Column, now: Column, half_life_days: float, min_score: float) -> Column:
    """max(min_score, 2 ** -(age / half-life)); 1 for a missing or future time. The age is in whole seconds."""
    age = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 1_000_000).cast("double") / 86_400.0
    aged = F.greatest(F.lit(float(min_score)), F.pow(F.lit(2.0), -age / half_life_days))
    return F.when(at.isNull() | (age <= 0), F.lit(1.0)).otherwise(aged)


def recency_factor(recency: Recency, now: datetime | Column, fields: Fields) -> Column:
    text = fields.text(recency.field)
    if text is None:
        return F.lit(1.0)
    return decay(stamp(text), now if isinstance(now, Column) else F.lit(now).cast("timestamp"), recency.half_life_days, recency.min_score)


def boost_factor(boosts: Sequence[Boost], fields: Fields) -> Column:
    """Product of the weights of the boosts that match; a value goes before a range."""
    factor = F.lit(1.0)
    for b in boosts:
        if b.value is not None:
            text = fields.text(b.field)
            match = None if text is None else text == F.lit(b.value)
        elif b.gte is not None or b.lte is not None:
            x = fields.number(b.field)
            match = None if x is None else ~F.isnan(x.cast("double"))
            if match is not None and b.gte is not None:
                match &= x >= F.lit(float(b.gte))
            if match is not None and b.lte is not None:
                match &= x <= F.lit(float(b.lte))
        else:
            match = None
        if match is not None:
            factor *= F.when(match, F.lit(float(b.weight))).otherwise(F.lit(1.0))
    return factor


def relationship_factor(candidates: DataFrame, boost: RelationshipBoost) -> DataFrame:
    """`candidates` (chunk_id, base_score, parent_id, group_id) with `relation`.

    Candidates are a few times top_k rows, so the greatest score, the parents' presence and the
    groups' sums are taken over all of them; siblings are the others of a group.
    """
    every, group = Window.partitionBy(), Window.partitionBy("group_id")
    most = F.greatest(F.max("base_score").over(every), F.lit(1e-10))
    rows = candidates.withColumn("__s", F.col("base_score") / most)
    rows = rows.withColumn("__parent", F.coalesce(F.array_contains(F.collect_set("chunk_id").over(every), F.col("parent_id")), F.lit(False)))
    n = F.count("group_id").over(group) - 1
    if boost.mode == "sum":
        agg = F.sum("__s").over(group) - F.col("__s")
    elif boost.mode == "avg":
        agg = (F.sum("__s").over(group) - F.col("__s")) / F.when(n > 0, n)
    else:
        # The greatest of the others: the first of the group has the second's score.
        two = Window.partitionBy("group_id").orderBy(F.desc("__s"), "chunk_id")
        first = F.row_number().over(two) == 1
        others = F.when(first, F.lead("__s").over(two)).otherwise(F.max("__s").over(group))
        agg = F.greatest(F.lit(0.0), others)
    siblings = F.when(F.col("group_id").isNotNull() & (n > 0), agg * boost.sibling_weight)
    relation = 1.0 + F.when(F.col("__parent"), boost.parent_weight).otherwise(0.0) + F.coalesce(siblings, F.lit(0.0))
    return rows.withColumn("relation", relation).drop("__s", "__parent")


def score_candidates(
    candidates: DataFrame,
    now: datetime | Column,
    recency: Recency | None = None,
    boosts: Sequence[Boost] = (),
    relationship: RelationshipBoost | None = None,
    fields: Fields | None = None,
) -> DataFrame:
    """`candidates` with final_score: base score times the factors that are asked for."""
    fields = fields or Fields()
    factor = F.lit(1.0)
    if recency:
        factor *= recency_factor(recency, now, fields)
    if boosts:
        factor *= boost_factor(boosts, fields)
    out = candidates.withColumn("__factor", factor)
    if relationship:
        out = relationship_factor(out, relationship)
        return out.withColumn("final_score", F.col("base_score") * F.col("__factor") * F.col("relation")).drop("__factor", "relation")
    return out.withColumn("final_score", F.col("base_score") * F.col("__factor")).drop("__factor")
