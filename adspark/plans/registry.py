"""All registered queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from adspark.plans import ads, retrieval, units

MODULES: tuple[ModuleType, ...] = (units, ads, retrieval)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= m.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.oracle_sql() if hasattr(m, "oracle_sql") else {}
    return out


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return ads.agg_pay_quartiles(spark, d)
