"""Queries over the project's tables for the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.llm import canonical, keywords, langid, leakage, ocr, packing, repetition, survivor, terms
from adspark.runtime import table


def _term_records(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "position_dict", "form_id", "surface", "count", "n_spans", "n_headings")
    return terms.dictionary_records(p, table(spark, d, "requirement_dict", "req_id", "surface", "count"))


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(_term_records(spark, d)).drop("share")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(_term_records(spark, d)).where("mark is not null").select("field", "term", "mark")


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages(table(spark, d, "ad_text", "ad_id", "text_norm", "lang")).select("ad_id", "label_code", "n_words", F.posexplode_outer("segments").alias("at", "s")).select("ad_id", "label_code", "n_words", (F.col("at") + 1).alias("seg_no"), "s.lang", "s.confidence")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(langid.languages(table(spark, d, "ad_text", "ad_id", "text_norm", "lang")))


def _printed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "ads"), table(spark, d, "ad_text"), table(spark, d, "ad_dups", "ad_id", "dup_cluster_id", "is_canonical")


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_records(*_printed(spark, d)).withColumn("filled", F.concat_ws(",", "filled"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # Which ad survives is the rank's to say; what its null fields are filled with shows in p3_survivors only.
    return survivor.wrongly_marked(survivor.best_printing(survivor.printings(*_printed(spark, d))))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ad_text", "ad_id", "flag_pc_repetition").withColumnRenamed("flag_pc_repetition", "flag")


def p4_repetition(spark: SparkSession, d: str) -> DataFrame:
    r = repetition.repetition(table(spark, d, "ads", "ad_id", "text"), flags=_flags(spark, d))
    return r.withColumn("votes", F.concat_ws(",", F.col("votes").cast("array<string>")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.found(table(spark, d, "ads", "ad_id", "text"), flags=_flags(spark, d))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    r = ocr.repair(table(spark, d, "ads", "ad_id", "text", "text_ocr", "newspaper"))
    return r.withColumn("n_items", F.size("items")).drop("items").dropDuplicates(["ad_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.found(ocr.repair(table(spark, d, "ads", "ad_id", "text", "text_ocr", "newspaper")))


def p6_positions(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_positions(table(spark, d, "position_dict"), table(spark, d, "job_titles"))


def p6_tags(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_tags(table(spark, d, "requirement_dict"), table(spark, d, "requirement_values"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    p = p6_positions(spark, d).where("not exact").select(F.lit("position").alias("field"), "row_id", "item_no", "ref_id")
    t = p6_tags(spark, d).where("not exact").select(F.lit("tag").alias("field"), "row_id", "item_no", "ref_id")
    return p.unionByName(t)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents", "doc_id", "text"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(p9_leaks(spark, d))


def p10_pages(spark: SparkSession, d: str) -> DataFrame:
    return keywords.stuffed(table(spark, d, "documents", "doc_id", "text", "source"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pages(spark, d).where("flagged and doc_id is not null").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_languages, p3_found, p3_survivors, p4_found, p4_repetition, p5_found, p5_texts, p6_found, p6_positions, p6_tags, p8_containers, p9_found, p9_leaks, p10_found, p10_pages)}


_TERMS = """
with recs as (
  select 'position' as field, form_id as id, any_value(surface) as surface, any_value(coalesce("count", coalesce(n_spans, 0) + coalesce(n_headings, 0))) as n from position_dict group by form_id
  union all
  select 'requirement', req_id, any_value(surface), any_value(coalesce("count", 1)) from requirement_dict group by req_id),
words as (
  select distinct field, id, n, unnest(regexp_extract_all(replace(lower(nfc_normalize(coalesce(surface, ''))), 'ſ', 's'), '\\p{L}+')) as term from recs),
sums as (select field, term, cast(sum(greatest(n, 0)) as bigint) as occurrences, count(*) as records from words group by field, term),
totals as (select field, count(*) as total from recs group by field),
marked as (
  select field, term, occurrences, records, case when records >= 0.02 * total then 'common' when occurrences < 5 then 'rare' end as mark
  from sums join totals using (field))
"""

_BEST = """
with d as (select ad_id, min(dup_cluster_id) as dup_cluster_id, bool_or(is_canonical) as is_canonical from ad_dups where ad_id is not null and dup_cluster_id is not null group by ad_id),
t as (select ad_id, min(n_flags) as n_flags, max(ocr_support) as ocr_support from ad_text group by ad_id),
a as (select ad_id, min(date) as date from ads group by ad_id),
x as (
  select *, row_number() over (partition by dup_cluster_id order by n_flags nulls last, ocr_support desc nulls last, date nulls last, ad_id) as rn,
    count(*) over (partition by dup_cluster_id) as size, count(*) filter (where is_canonical) over (partition by dup_cluster_id) as n_marked
  from d left join t using (ad_id) left join a using (ad_id))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _TERMS + "select field, term, mark from marked where mark is not null",
        "p1_terms": _TERMS + "select field, term, occurrences, records, mark from marked",
        "p3_found": _BEST + "select dup_cluster_id, ad_id from x where rn = 1 and size > 1 and not (n_marked = 1 and coalesce(is_canonical, false))",
    }
