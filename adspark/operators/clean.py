"""The clean table: one row per ad, all steps joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.operators import dictionary, pay
from adspark.operators.filters import BENEFITS, FilterSpec


def distinct_list(c: str | Column) -> Column:
    """The distinct non-null values, sorted; NULL if there is none."""
    x = F.collect_set(c)
    return F.when(F.size(x) > 0, F.sort_array(x))


def position_lists(positions: DataFrame) -> DataFrame:
    """Per ad the distinct terms, lemmas, modern names and categories, and the gender its forms agree on."""
    f, m, neutral = F.col("gender_form") == "f", F.col("gender_form") == "m", F.col("gender_form").isin("m/f", "n")
    gender = F.when(F.bool_and(f), "f").when(F.bool_and(m), "m").when(F.bool_or(f) & F.bool_or(m), "mixed").when(F.bool_and(neutral), "neutral")
    return positions.groupBy("ad_id").agg(distinct_list("term").alias("position_terms"), distinct_list("lemma").alias("position_lemmas"), distinct_list("modern").alias("position_modern"), distinct_list("category").alias("position_categories"), gender.alias("position_gender"))


def requirement_lists(requirements: DataFrame) -> DataFrame:
    """Per ad the distinct requirements, their tags as 'dimension:value' and the distinct dimensions."""
    tag = F.concat_ws(":", "dimension", "value")
    return requirements.groupBy("ad_id").agg(distinct_list(F.when(F.col("value").isNotNull() & F.col("dimension").isNotNull(), tag)).alias("requirement_tags"), distinct_list("dimension").alias("requirement_dimensions"), distinct_list(F.struct("dimension", "group", "value", "detail", "in_vocab")).alias("requirements"))


def amounts(ad_salary: DataFrame) -> DataFrame:
    """Per ad its amounts in order of place."""
    s = ad_salary.where("amount_min is not null").dropDuplicates(["ad_id", "span_start"])
    one = F.struct("span_start", "amount_min", "amount_max", "currency", "standard", "component", "period")
    return s.groupBy("ad_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("span_start")).alias("salary_amounts"))


def build(ads: DataFrame, ad_text: DataFrame, ad_dups: DataFrame, position_dict: DataFrame, requirement_dict: DataFrame, ad_salary: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Inner joins of ads, text and clusters, left joins of sides aggregated to one row per ad before they are joined.

    All joins are on ad_id, so the shuffles share one partitioning. Restrictions of `spec` on columns of the scanned tables
    stand below the de-duplication, in which repeated deliveries are equal, so they reach the scans; the caller applies the
    whole of `spec` to the result.
    """
    if spec is not None:
        on_ads, on_text = spec.scan_conditions()
        ads, ad_text = ads.where(on_ads), ad_text.where(on_text)
    a = ads.dropDuplicates(["ad_id"]).select("ad_id", "newspaper", F.col("year").cast("short").alias("year"), "date", "decade", "page", "label", "iiif_link", "heading_text", "text")
    flags = ["flag_pc_repetition", "flag_pc_expanded", "flag_pc_unsupported", "flag_too_short", "flag_death_register"]
    t = ad_text.dropDuplicates(["ad_id"]).select("ad_id", "text_norm", "lang", "n_flags", *flags)
    d = ad_dups.dropDuplicates(["ad_id"]).select("ad_id", "dup_cluster_id", "dup_cluster_size", "is_canonical", "run_first_date", "run_last_date")
    c = a.join(t, "ad_id").join(d, "ad_id")
    for side in (position_lists(dictionary.ad_positions(ads, position_dict)), requirement_lists(dictionary.ad_requirements(ads, requirement_dict, ad_text)), pay.main_pay(ad_salary), pay.benefits(ads, ad_salary, ad_text), amounts(ad_salary)):
        c = c.join(side, "ad_id", "left")
    searchable = ~F.col("flag_death_register") & (F.col("label") != "heading")
    warning = F.when(F.col("flag_pc_unsupported"), "text not supported by the scan").when(F.col("flag_pc_repetition"), "text repeated by the correction").when(F.col("flag_too_short"), "very short text")
    c = c.withColumn("searchable", searchable).withColumn("countable", searchable & F.col("is_canonical") & ~F.col("flag_pc_unsupported")).withColumn("quality_warning", warning)
    return c.withColumns({"pay_amounts": F.coalesce("pay_amounts", F.lit(0)), **{f"benefit_{b}": F.coalesce(f"benefit_{b}", F.lit(False)) for b in BENEFITS}})


def summarize(clean: DataFrame) -> DataFrame:
    """One row of counts and coverage."""
    share = lambda c: F.round(F.avg(F.when(F.col("countable"), c.cast("int"))).cast("decimal(20,10)") * 100, 1).cast("double")
    return clean.agg(F.count("*").alias("ads"), F.count_if("searchable").alias("searchable"), F.count_if("countable").alias("countable"), share(F.col("position_lemmas").isNotNull()).alias("pct_position"), share(F.col("requirement_tags").isNotNull()).alias("pct_requirements"), share(F.col("pay_min").isNotNull()).alias("pct_pay"))
