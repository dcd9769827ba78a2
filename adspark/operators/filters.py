"""Restrictions on ads as composable column conditions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BENEFITS = ("wohnung", "kost", "kleidung", "heizung", "licht", "deputat", "quartiergeld", "zulagen")
LISTS = ("position_categories", "position_lemmas", "requirement_dimensions", "requirement_tags")


def overlaps(column: str, values: list[str]) -> Column:
    """Whether the list column holds any of the values; NULL lists and NULL elements do not match."""
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False))


@dataclass
class FilterSpec:
    """Optional restrictions, all of which must hold; list restrictions match any of their values, benefits all of theirs."""

    newspapers: list[str] | None = None
    year_from: int | None = None
    year_to: int | None = None
    labels: list[str] | None = None
    langs: list[str] | None = None
    countable_only: bool = False
    position_gender: list[str] | None = None
    position_categories: list[str] | None = None
    position_lemmas: list[str] | None = None
    requirement_dimensions: list[str] | None = None
    requirement_tags: list[str] | None = None
    has_pay: bool | None = None
    benefits: list[str] = field(default_factory=list)
    where: str | None = None

    def column(self) -> Column:
        """The condition on the clean table; true without restrictions. See scan_conditions for what reaches the scans."""
        unknown = [b for b in self.benefits if b not in BENEFITS]
        if unknown:
            raise ValueError(f"unknown benefit {unknown[0]!r}; known: {', '.join(BENEFITS)}")
        c = [F.col(n).isin(v) for n, v in (("newspaper", self.newspapers), ("label", self.labels), ("lang", self.langs), ("position_gender", self.position_gender)) if v]
        if self.year_from is not None:
            c.append(F.col("year") >= self.year_from)
        if self.year_to is not None:
            c.append(F.col("year") <= self.year_to)
        if self.countable_only:
            c.append(F.col("countable"))
        c += [overlaps(n, v) for n in LISTS if (v := getattr(self, n))]
        if self.has_pay is not None:
            c.append(F.col("pay_min").isNotNull() if self.has_pay else F.col("pay_min").isNull())
        c += [F.col(f"benefit_{b}") for b in self.benefits]
        if self.where:
            c.append(F.expr(self.where))
        return reduce(lambda a, b: a & b, c, F.lit(True))

    def scan_conditions(self) -> tuple[Column, Column]:
        """The part of the condition that stands on columns of the ads table, and that on columns of the text table."""
        ads = [F.col(n).isin(v) for n, v in (("newspaper", self.newspapers), ("label", self.labels)) if v]
        if self.year_from is not None:
            ads.append(F.col("year") >= self.year_from)
        if self.year_to is not None:
            ads.append(F.col("year") <= self.year_to)
        texts = [F.col("lang").isin(self.langs)] if self.langs else []
        if self.countable_only:
            ads.append(F.col("label") != "heading")
            texts.append(~F.col("flag_death_register") & ~F.col("flag_pc_unsupported"))
        return reduce(lambda a, b: a & b, ads, F.lit(True)), reduce(lambda a, b: a & b, texts, F.lit(True))
