"""Counts, shares and pay statistics of ads per group."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.operators.filters import BENEFITS, FilterSpec

MOST_GROUPS = 40
ORDERED = ("decade", "year")  # time series are sorted by group and never cut
SCALAR = ("decade", "year", "label", "newspaper", "position_gender")
LISTS = {"position_category": "position_categories", "position_lemma": "position_lemmas", "position_modern": "position_modern", "requirement_dimension": "requirement_dimensions"}


@dataclass
class AggregateSpec:
    measure: str = "count"  # count, share, pay
    group_by: str = "none"
    filters: FilterSpec = field(default_factory=FilterSpec)
    subset: FilterSpec | None = None
    dimension: str | None = None


def group_column(group_by: str, dimension: str | None = None) -> tuple[Column, bool]:
    """The grouping expression and whether it is a list (then every element is a group and ads without one drop out)."""
    if group_by == "none":
        return F.lit("alle"), False
    if group_by in SCALAR:
        return F.col(group_by), False
    if group_by in LISTS:
        return F.col(LISTS[group_by]), True
    if group_by == "requirement_value":
        tags = F.col("requirement_tags")
        if dimension:
            tags = F.transform(F.filter(tags, lambda t: t.startswith(dimension + ":")), lambda t: F.substr(t, F.lit(len(dimension) + 2)))
        return tags, True
    if group_by == "benefit":
        return F.array_compact(F.array(*[F.when(F.col(f"benefit_{b}"), F.lit(b)) for b in BENEFITS])), True
    raise ValueError(f"unknown group {group_by!r}")


def aggregate(base: DataFrame, spec: AggregateSpec) -> DataFrame:
    """One row per group (and unit of pay), over countable ads. A NULL scalar group is kept, NULL list elements are not."""
    if spec.measure == "share" and spec.subset is None:
        raise ValueError("a share needs a subset")
    kept = base.where(spec.filters.column() & F.col("countable"))
    g, many = group_column(spec.group_by, spec.dimension)
    own = [F.col("ad_id"), *([F.col("pay_min"), F.col("pay_max"), F.col("pay_currency"), F.col("pay_standard"), F.col("pay_period")] if spec.measure == "pay" else [])]
    inside = [spec.subset.column().alias("inside")] if spec.measure == "share" else []
    rows = kept.select(*own, *inside, (F.explode(F.array_distinct(g)) if many else g).alias("g"))
    if many:
        rows = rows.where("g is not null")
    if spec.measure == "count":
        return rows.groupBy("g").agg(F.countDistinct("ad_id").alias("n"))
    if spec.measure == "share":
        out = rows.groupBy("g").agg(F.countDistinct("ad_id").alias("n_base"), F.countDistinct(F.when(F.col("inside"), F.col("ad_id"))).alias("n"))
        return out.withColumn("share_pct", F.round((F.lit(100) * F.col("n") / F.col("n_base")).cast("decimal(20,10)"), 2).cast("double"))
    m = (F.col("pay_min") + F.col("pay_max")) / 2
    paid = rows.where("pay_min is not null").withColumn("m", m)
    keys = ["g", F.col("pay_currency").alias("currency"), F.col("pay_standard").alias("standard"), F.col("pay_period").alias("period")]
    return paid.groupBy(*keys).agg(F.countDistinct("ad_id").alias("n"), *[F.percentile("m", q).alias(a) for a, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))], F.min("m").alias("min"), F.max("m").alias("max"))


def top_groups(rows: DataFrame, group_by: str, measure: str, most: int = MOST_GROUPS) -> DataFrame:
    """Ordered for display: time groups by group, the others by size, cut to `most` (a report's limit, not a sample)."""
    if group_by in ORDERED:
        return rows.orderBy("g")
    return rows.orderBy(F.desc("n_base" if measure == "share" else "n"), F.col("g").asc_nulls_last()).limit(most)
