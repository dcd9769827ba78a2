"""Dictionaries of distinct forms: collected from mentions, annotated once per form, joined back to every mention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.text import form_key, grounded, normalize_text, snippet
from adspark.functions.unicode import nfc

REQUIREMENT_COLUMNS = ("activity", "attitude_towards_work", "background", "interpersonal", "job_specific", "language")
HARMONIZE_SHARE = 0.75


def position_spans(ads: DataFrame) -> DataFrame:
    """One row per position mention of every ad (delivered twice: once)."""
    a = ads.select("ad_id", "newspaper", "year", "text", "positions").dropDuplicates(["ad_id"])
    p = a.select("ad_id", "newspaper", "year", "text", F.explode("positions").alias("p"))
    return p.select("ad_id", "newspaper", "year", "text", F.col("p.start").alias("span_start"), F.col("p.end").alias("span_end"), F.col("p.text").alias("form"), F.col("p.gender").alias("gender"))


def without_registers(spans: DataFrame, ad_text: DataFrame | None) -> DataFrame:
    """Spans of ads that are no death registers; ads without a text row or flag stay."""
    if ad_text is None:
        return spans
    return spans.join(ad_text.where("flag_death_register").select("ad_id").distinct(), "ad_id", "left_anti")


def requirement_spans(ads: DataFrame, columns: tuple[str, ...] = REQUIREMENT_COLUMNS, ad_text: DataFrame | None = None) -> DataFrame:
    """One row per requirement mention: all span columns in one generate, so the ads are read once.

    With `ad_text`, death registers are left out; position mentions (see position_spans) keep them.
    """
    a = ads.select("ad_id", "newspaper", "year", "text", *columns).dropDuplicates(["ad_id"])

    def tagged(c: str):
        return F.transform(F.coalesce(F.col(c), F.array()), lambda s: F.struct(F.lit(c).alias("column"), s["start"].alias("span_start"), s["end"].alias("span_end"), s["text"].alias("phrase")))

    all_ = F.flatten(F.array(*[tagged(c) for c in columns]))
    return without_registers(a, ad_text).select("ad_id", "newspaper", "year", "text", F.explode(all_).alias("s")).select("ad_id", "newspaper", "year", "text", "s.*")


def collect_forms(spans: DataFrame, headings: DataFrame) -> DataFrame:
    """key, surface (most frequent form, ties to the smaller), n_spans, n_headings, count, extracted_gender (JSON by value).

    Spans and headings are counted by (key, form, gender) first, so a key that a third of all mentions share is a few rows
    before its histogram is built.
    """
    s = spans.select(form_key(F.col("form")).alias("key"), "form", F.coalesce("gender", F.lit("unknown")).alias("gender"), F.lit(1).alias("s"), F.lit(0).alias("h"))
    h = headings.select(form_key(F.col("heading")).alias("key"), F.col("heading").alias("form"), F.lit(None).cast("string").alias("gender"), F.lit(0).alias("s"), F.lit(1).alias("h"))
    fine = s.unionByName(h).where("key <> ''").groupBy("key", "form", "gender").agg(F.sum("s").alias("s"), F.sum("h").alias("h"))
    by_form = fine.groupBy("key", "form").agg(F.sum("s").alias("s"), F.sum("h").alias("h"))
    top = by_form.groupBy("key").agg(F.min(F.struct((-F.col("s")).alias("a"), (-F.col("h")).alias("b"), "form"))["form"].alias("form"), F.sum("s").cast("int").alias("n_spans"), F.sum("h").cast("int").alias("n_headings"))
    genders = fine.where("gender is not null").groupBy("key", "gender").agg(F.sum("s").alias("n")).groupBy("key").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gender", "n"))))).alias("extracted_gender"))
    surface = F.regexp_replace(normalize_text(F.col("form")), r"^[ .,;:-]+|[ .,;:-]+$", "")
    return top.join(genders, "key", "left").select("key", surface.alias("surface"), (F.col("n_spans") + F.col("n_headings")).alias("count"), "n_spans", "n_headings", F.coalesce("extracted_gender", F.lit("{}")).alias("extracted_gender"))


def collect_phrases(spans: DataFrame) -> DataFrame:
    """One row per (column, phrase key): distinct ads, most frequent surface, up to three contexts from first, middle and last year.

    The rows that give contexts are picked by rank with two window passes over (column, key); ties in year go by ad and place.
    """
    s = spans.select("ad_id", "year", "column", "text", "span_start", "span_end", "phrase", form_key(F.col("phrase"), enumerations=False).alias("phrase_key")).where("phrase_key <> ''")
    first = s.groupBy("column", "phrase_key", "ad_id").agg(F.min(F.struct("span_start", "span_end", "year", "phrase", "text")).alias("x")).select("column", "phrase_key", "ad_id", "x.*")
    w = Window.partitionBy("column", "phrase_key")
    ranked = first.withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("year", "ad_id")))
    mid = F.floor(F.col("n") / 2) + 1
    few = (F.col("n") < 3) & (F.col("rn") == mid)
    many = (F.col("n") >= 3) & ((F.col("rn") == 1) | (F.col("rn") == mid) | (F.col("rn") == F.col("n")))
    ctx = ranked.where(few | many).groupBy("column", "phrase_key").agg(F.max("n").cast("int").alias("count"), F.array_sort(F.collect_list(F.struct("rn", snippet(F.col("text"), F.col("span_start"), F.col("span_end"), 50).alias("s")))).alias("c"))
    top = first.groupBy("column", "phrase_key", "phrase").agg(F.count("*").alias("k")).groupBy("column", "phrase_key").agg(F.min(F.struct((-F.col("k")).alias("a"), "phrase"))["phrase"].alias("phrase"))
    surface = F.regexp_replace(normalize_text(F.col("phrase")), r"^[ .,;:-]+|[ .,;:-]+$", "")
    return ctx.join(top, ["column", "phrase_key"]).select(F.concat_ws(":", "column", "phrase_key").alias("key"), "column", "phrase_key", "count", surface.alias("surface"), F.array_join(F.transform("c", lambda x: x["s"]), " ‖ ").alias("context"))


def unique_forms(dictionary: DataFrame, id_column: str) -> DataFrame:
    """One row per key: the row of smallest id, so that keys listed several times multiply no mentions."""
    d = dictionary.where("key is not null").dropDuplicates([id_column])
    best = d.groupBy("key").agg(F.min(id_column).alias(id_column))
    return d.join(best, ["key", id_column], "left_semi")


def ad_positions(ads: DataFrame, position_dict: DataFrame) -> DataFrame:
    """One row per (mention, dictionary entry) for mentions that name a position; headings count for the ad below them.

    The dictionary grows with the data, so Spark chooses the join by its measured size.
    """
    spans = position_spans(ads).select("ad_id", "newspaper", "year", F.lit("span").alias("source"), "span_start", "span_end", F.col("form").alias("surface"), F.col("gender").alias("extracted_gender"))
    head = ads.where("heading_text is not null").select("ad_id", "newspaper", "year", "heading_text").dropDuplicates(["ad_id"])
    heads = head.select("ad_id", "newspaper", "year", F.lit("heading").alias("source"), F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_end"), F.col("heading_text").alias("surface"), F.lit(None).cast("string").alias("extracted_gender"))
    m = spans.unionByName(heads).withColumn("key", form_key(F.col("surface")))
    d = unique_forms(position_dict, "form_id").where("is_position").select("key", "entries", "confidence")
    out = m.join(d, "key").select(*m.columns, "confidence", F.explode("entries").alias("e"))
    return out.select("ad_id", "newspaper", "year", "source", "span_start", "span_end", "surface", "key", "extracted_gender", "e.term", "e.lemma", "e.modern", "e.gender_form", "e.category", "confidence")


def ad_requirements(ads: DataFrame, requirement_dict: DataFrame, ad_text: DataFrame | None = None) -> DataFrame:
    """One row per (phrase mention, tag) for informative phrases; tags that a check rejected are left out."""
    m = requirement_spans(ads, ad_text=ad_text).drop("text").withColumn("key", F.concat_ws(":", "column", form_key(F.col("phrase"), enumerations=False)))
    d = unique_forms(requirement_dict, "req_id").where("is_informative").select("key", "tags")
    out = m.join(d, "key").select("ad_id", "newspaper", "year", "column", "span_start", "span_end", "phrase", F.explode("tags").alias("t")).where("coalesce(t.verified, true)")
    return out.select("ad_id", "newspaper", "year", "column", "span_start", "span_end", "phrase", "t.dimension", "t.group", "t.value", "t.detail", "t.in_vocab")


def harmonize_categories(position_dict: DataFrame, share: float = HARMONIZE_SHARE) -> DataFrame:
    """Entries exploded, with the category that has at least `share` of the lemma's mentions where there is one."""
    e = position_dict.select("form_id", F.coalesce("count", F.lit(1)).alias("count"), F.posexplode("entries").alias("entry_no", "e")).select("form_id", "count", "entry_no", "e.term", "e.lemma", "e.category")
    votes = e.where("lemma is not null").groupBy(F.lower("lemma").alias("low"), "category").agg(F.sum("count").alias("n"))
    top = votes.groupBy("low").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("t")).where(-F.col("t.m") >= F.lit(share) * F.col("total")).select("low", F.col("t.category").alias("dominant"))
    out = e.withColumn("low", F.lower("lemma")).join(top, "low", "left")
    return out.select("form_id", "entry_no", "lemma", "category", F.coalesce("dominant", "category").alias("harmonized"))


def form_conflicts(position_dict: DataFrame) -> DataFrame:
    """Lemmas that have several categories."""
    e = position_dict.select(F.explode("entries").alias("e")).select("e.lemma", "e.category").where("lemma is not null")
    return e.groupBy("lemma").agg(F.countDistinct("category").alias("n_categories")).where("n_categories > 1")


def verification_candidates(requirement_dict: DataFrame) -> DataFrame:
    """Tags whose value does not occur in their phrase: to be checked without context."""
    t = requirement_dict.dropDuplicates(["req_id"]).select("req_id", "key", "column", "surface", F.posexplode("tags").alias("tag_no", "t")).where("t.value is not null")
    t = t.withColumn("_v", nfc(F.col("t.value"))).withColumn("_s", nfc(F.col("surface")))
    return t.where(~grounded(F.col("_v"), F.col("_s"))).select("req_id", "key", "tag_no", "column", "surface", F.col("t.dimension").alias("dimension"), F.col("t.value").alias("value"))


def apply_verification(requirement_dict: DataFrame, results: DataFrame) -> DataFrame:
    """Sets `verified` of the tags in results (req_id, tag_no, stated); a phrase whose tags are all rejected is not informative."""
    t = requirement_dict.select("req_id", F.posexplode("tags").alias("tag_no", "t")).join(results, ["req_id", "tag_no"], "left")
    fixed = t.withColumn("t", F.col("t").withField("verified", F.coalesce("stated", F.col("t.verified")))).groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("tag_no", "t"))).alias("x"))
    new = fixed.select("req_id", F.transform("x", lambda y: y["t"]).alias("new_tags"))
    out = requirement_dict.join(new, "req_id", "left").withColumn("tags", F.coalesce("new_tags", "tags")).drop("new_tags")
    return out.withColumn("is_informative", F.when(F.col("tags").isNotNull(), F.exists("tags", lambda x: F.coalesce(x["verified"], F.lit(True)))))


def annotate(forms: DataFrame, key: str, text: str, handler: Callable[[list[str]], list[str | None]], batch: int = 25) -> DataFrame:
    """(key, annotation): a pluggable annotator over distinct forms, in batches.

    A batch that fails is halved and asked again; a single form that fails gives NULL. Only forms, never mentions, are asked.
    """

    def ask(texts: list[str]) -> list[str | None]:
        try:
            got = handler(texts)
            if len(got) == len(texts):
                return got
        except Exception:  # noqa: BLE001 - an annotator may fail in any way; its failures are data here
            pass
        if len(texts) <= 1:
            return [None] * len(texts)
        half = len(texts) // 2
        return ask(texts[:half]) + ask(texts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[str | None] = []
            for at in range(0, len(b), batch):
                out += ask(b["t"].iloc[at : at + batch].tolist())
            yield pd.DataFrame({"k": b["k"], "annotation": out})

    src = forms.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInPandas(run, f"k {kind}, annotation string").withColumnRenamed("k", key)


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: forms annotated in both runs and the share on which they agree."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return j.agg(F.count("*").alias("forms"), F.avg(F.col("x").eqNullSafe(F.col("y")).cast("int")).alias("same"))

