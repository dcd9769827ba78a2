"""Queries for amounts in different units (problem 7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.operators.units import convert
from adspark.runtime import table

NEEDED = ("ad_id", "year", "span_start", "phrase", "amount_min", "amount_max", "currency", "standard", "period")


def _converted(spark: SparkSession, d: str) -> DataFrame:
    return convert(table(spark, d, "ad_salary", *NEEDED), table(spark, d, "pay_units"))


def p7_amounts(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d).select("ad_id", "span_start", "phrase", "amount_min", "unit_id", "unit_source", "posterior", "uncertain", "kronen_min", "kronen_max")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "pay_units").where("unit_name in ('Krone', 'Kronen')").select("unit_id")
    r = _converted(spark, d).where(F.col("amount_min").isNotNull() & F.col("unit_id").isNotNull() & ~F.col("uncertain"))
    return r.select("ad_id", "span_start", "unit_id").join(F.broadcast(units), "unit_id", "left_anti").select("ad_id", "span_start", "unit_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p7_found": p7_found, "p7_amounts": p7_amounts}
