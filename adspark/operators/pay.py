"""Amounts per ad: the dominant unit with its range, and benefits named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.functions.text import normalize_text
from adspark.operators.dictionary import without_registers

PAY = ("gehalt", "lohn", "remuneration", "taggeld")
# What names a benefit (substring matches, as in the data's own rules).
BENEFIT_PATTERNS = {
    "wohnung": r"wohnung|quartier(?!geld)|unterkunft|logis|zimmer", "kost": r"kost(?!en)|verpflegung|verköstigung|brot|tisch|mittagessen|verpflegs",
    "kleidung": r"kleidung|montur|livree|uniform", "heizung": r"heizung|beheizung|holz|brennmaterial|kohle", "licht": r"beleuchtung|licht|kerzen",
    "deputat": r"deputat|naturalbez|naturalien|getreide|korn", "quartiergeld": r"[qo]uar?t[\w-]{0,2}ergeld|wohnungsgeld|zinsbeitrag", "zulagen": r"zulage|adjut|pauschal",
}


def main_pay(ad_salary: DataFrame, components: tuple[str, ...] = PAY) -> DataFrame:
    """Per ad the most frequent unit (currency, standard, period) of its amounts and the range inside it; ties by unit."""
    s = ad_salary.dropDuplicates(["ad_id", "span_start"]).where(F.col("amount_min").isNotNull() & F.col("component").isin(*components))
    unit = [F.coalesce("currency", F.lit("")).alias("c"), F.coalesce("standard", F.lit("")).alias("s"), F.coalesce("period", F.lit("")).alias("p")]
    g = s.groupBy("ad_id", *unit).agg(F.count("*").alias("n"), F.min("amount_min").alias("lo"), F.max(F.coalesce("amount_max", "amount_min")).alias("hi"))
    best = g.groupBy("ad_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "c", "s", "p", "n", "lo", "hi")).alias("x"))
    none = F.lit("")
    return best.select("ad_id", F.col("x.lo").alias("pay_min"), F.col("x.hi").alias("pay_max"), F.nullif("x.c", none).alias("pay_currency"), F.nullif("x.s", none).alias("pay_standard"), F.nullif("x.p", none).alias("pay_period"), F.col("x.n").cast("short").alias("pay_amounts"))


def benefits(ads: DataFrame, ad_salary: DataFrame | None = None, ad_text: DataFrame | None = None) -> DataFrame:
    """Per ad one flag per benefit named in its board and unspecific pay spans or by the component of one of its amounts.

    Spans of death registers (by ad_text, where given) name none. Flags are raised per phrase, then combined map-side.
    """
    a = ads.select("ad_id", "verpflegung", "unspecific_salary").dropDuplicates(["ad_id"])
    s = a.select("ad_id", F.explode(F.concat(F.coalesce("verpflegung", F.array()), F.coalesce("unspecific_salary", F.array()))).alias("x")).select("ad_id", F.lower(normalize_text(F.col("x.text"))).alias("p"))
    s = without_registers(s, ad_text)
    if ad_salary is not None:
        s = s.unionByName(ad_salary.where("component is not null and ad_id is not null").select("ad_id", F.lower("component").alias("p")).distinct())
    return s.groupBy("ad_id").agg(*[F.bool_or(F.col("p").rlike(rx)).alias(f"benefit_{b}") for b, rx in BENEFIT_PATTERNS.items()])
