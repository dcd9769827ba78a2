"""Registered queries over the project's tables: the clean table and the analyses on it, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adspark.functions import text as T
from adspark.functions.unicode import nfc
from adspark.operators import amounts, clean, dedup, dictionary, index, pay, quality, tools
from adspark.operators.aggregate import AggregateSpec, aggregate, top_groups
from adspark.operators.components import components
from adspark.operators.filters import FilterSpec
from adspark.plans import sql as S
from adspark.runtime import once, table
from adspark.sources.tables import link_headings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def base(spark: SparkSession, d: str, spec: FilterSpec | None = None) -> DataFrame:
    names = ("ads", "ad_text", "ad_dups", "position_dict", "requirement_dict", "ad_salary")
    return clean.build(*[table(spark, d, n) for n in names], spec=spec)


def _flat(df: DataFrame, *lists: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ";") for c in lists})


def _agg(spark: SparkSession, d: str, **kw) -> DataFrame:
    spec = AggregateSpec(**kw)
    return aggregate(base(spark, d, spec.filters), spec)


# ---------------------------------------------------------------- clean table

_CLEAN_COLUMNS = "ad_id, newspaper, year, label, lang, searchable, countable, quality_warning, position_gender, pay_min, pay_max, pay_currency, pay_standard, pay_period, benefit_wohnung, benefit_kost"


@register(S.CLEAN + f"select {_CLEAN_COLUMNS}, array_to_string(position_lemmas, ';') as position_lemmas, array_to_string(position_categories, ';') as position_categories, array_to_string(requirement_tags, ';') as requirement_tags, n_requirements from clean")
def clean_star_join(spark, d):
    n = F.coalesce(F.size("requirements"), F.lit(0)).cast("long").alias("n_requirements")
    return _flat(base(spark, d), "position_lemmas", "position_categories", "requirement_tags").select(*_CLEAN_COLUMNS.split(", "), "position_lemmas", "position_categories", "requirement_tags", n)


@register(S.CLEAN + "select count(*) as ads, count(*) filter (where searchable) as searchable, count(*) filter (where countable) as countable, " + ", ".join(f"cast(round(cast(avg(case when countable then ({c} is not null)::int end) as decimal(20,10)) * 100, 1) as double) as {n}" for c, n in (("position_lemmas", "pct_position"), ("requirement_tags", "pct_requirements"), ("pay_min", "pct_pay"))) + " from clean")
def clean_summary(spark, d):
    return clean.summarize(base(spark, d))


@register(f"with {S.SAL} select ad_id, count(*) as n, array_to_string(list(cast(round(amount_min * 100) as bigint) order by span_start), ';') as amounts from s where amount_min is not null group by ad_id")
def clean_amounts_ordered(spark, d):
    x = clean.amounts(table(spark, d, "ad_salary"))
    cents = F.transform("salary_amounts", lambda s: F.round(s["amount_min"] * 100).cast("long").cast("string"))
    return x.select("ad_id", F.size("salary_amounts").cast("long").alias("n"), F.array_join(cents, ";").alias("amounts"))


@register(f"with {S.ADS}, {S.POSITIONS} select ad_id, source, span_start, surface, \"key\", lemma, category from ap")
def dict_positions_join_back(spark, d):
    return dictionary.ad_positions(table(spark, d, "ads"), table(spark, d, "position_dict")).select("ad_id", "source", "span_start", "surface", "key", "lemma", "category")


@register(f"with {S.ADS}, {S.REQUIREMENTS} select ad_id, \"column\", span_start, phrase, dimension, value, detail from ar")
def dict_requirements_join_back(spark, d):
    return dictionary.ad_requirements(table(spark, d, "ads"), table(spark, d, "requirement_dict"), table(spark, d, "ad_text", "ad_id", "flag_death_register")).select("ad_id", "column", "span_start", "phrase", "dimension", "value", "detail")


@register(f"with {S.SAL}, {S.PAY} select ad_id, pay_min, pay_max, pay_currency, pay_standard, pay_period, pay_amounts from pay")
def main_pay_mode(spark, d):
    return pay.main_pay(table(spark, d, "ad_salary"))


@register(f"with {S.ADS}, {S.BENEFITS} select * from ben")
def benefit_flags(spark, d):
    return pay.benefits(table(spark, d, "ads", "ad_id", "verpflegung", "unspecific_salary"), table(spark, d, "ad_salary", "ad_id", "component"), table(spark, d, "ad_text", "ad_id", "flag_death_register"))


# ---------------------------------------------------------------- aggregate tool


@register(S.CLEAN + "select decade as g, count(distinct ad_id) as n from clean where countable group by 1")
def agg_count_decade(spark, d):
    return _agg(spark, d, group_by="decade")


@register(S.CLEAN + "select 'alle' as g, count(distinct ad_id) as n from clean where countable")
def agg_none(spark, d):
    return _agg(spark, d)


@register(S.CLEAN + "select g, count(distinct ad_id) as n from (select ad_id, unnest(position_categories) as g from clean where countable) group by 1")
def agg_count_list_field(spark, d):
    return _agg(spark, d, group_by="position_category")


@register(S.CLEAN + "select position_gender as g, count(distinct ad_id) as n from clean where countable group by 1")
def agg_null_group_kept(spark, d):
    return _agg(spark, d, group_by="position_gender")


@register(S.CLEAN + "select g, count(distinct ad_id) as n_base, count(distinct ad_id) filter (where benefit_wohnung) as n, cast(round(cast(100 * count(distinct ad_id) filter (where benefit_wohnung) / count(distinct ad_id) as decimal(20,10)), 2) as double) as share_pct from (select *, label as g from clean where countable) group by g")
def agg_share_subset(spark, d):
    return _agg(spark, d, measure="share", group_by="label", subset=FilterSpec(benefits=["wohnung"]))


@register(S.CLEAN + "select decade as g, pay_currency as currency, pay_standard as standard, pay_period as period, count(distinct ad_id) as n, quantile_cont(m, 0.25) as p25, median(m) as median, quantile_cont(m, 0.75) as p75, min(m) as min, max(m) as max from (select *, (pay_min + pay_max) / 2 as m from clean where countable and pay_min is not null) group by all")
def agg_pay_quartiles(spark, d):
    return _agg(spark, d, measure="pay", group_by="decade")


_B = "list_filter([" + ", ".join(f"case when benefit_{b} then '{b}' end" for b in ("wohnung", "kost", "kleidung", "heizung", "licht", "deputat", "quartiergeld", "zulagen")) + "], lambda x: x is not null)"


@register(S.CLEAN + f"select g, count(distinct ad_id) as n from (select ad_id, unnest({_B}) as g from clean where countable) group by 1")
def agg_benefit_groups(spark, d):
    return _agg(spark, d, group_by="benefit")


@register(S.CLEAN + "select g, count(distinct ad_id) as n from (select ad_id, unnest(requirement_tags) as g from clean where countable) group by 1")
def agg_tag_values(spark, d):
    return _agg(spark, d, group_by="requirement_value")


@register(S.CLEAN + "select substr(g, 12) as g, count(distinct ad_id) as n from (select ad_id, unnest(requirement_tags) as g from clean where countable) where starts_with(g, 'fertigkeit:') group by 1")
def agg_tag_values_dimension(spark, d):
    return _agg(spark, d, group_by="requirement_value", dimension="fertigkeit")


@register(S.CLEAN + "select g, count(distinct ad_id) as n from (select ad_id, unnest(position_lemmas) as g from clean where countable) group by 1 order by n desc, g limit 40")
def agg_top40_cut(spark, d):
    return top_groups(_agg(spark, d, group_by="position_lemma"), "position_lemma", "count")


# ---------------------------------------------------------------- filters


def _filtered(spark, d, **kw):
    spec = FilterSpec(**kw)
    return base(spark, d, spec).where(spec.column()).select("ad_id")


@register(S.CLEAN + "select ad_id from clean where year between 1880 and 1899 and label in ('job_offer', 'vermittlung')")
def filter_year_range(spark, d):
    return _filtered(spark, d, year_from=1880, year_to=1899, labels=["job_offer", "vermittlung"])


@register(S.CLEAN + "select ad_id from clean where coalesce(list_has_any(position_categories, ['Haushalt', 'Erziehung']), false)")
def filter_list_overlap(spark, d):
    return _filtered(spark, d, position_categories=["Haushalt", "Erziehung"])


@register(S.CLEAN + "select ad_id from clean where benefit_wohnung and benefit_kost")
def filter_all_benefits(spark, d):
    return _filtered(spark, d, benefits=["wohnung", "kost"])


@register(S.CLEAN + "select ad_id from clean where pay_min is not null and position_gender in ('f')")
def filter_has_pay(spark, d):
    return _filtered(spark, d, has_pay=True, position_gender=["f"])


@register(S.CLEAN + "select ad_id from clean where countable and lang in ('fr', 'it')")
def filter_countable(spark, d):
    return _filtered(spark, d, countable_only=True, langs=["fr", "it"])


@register(f"with {S.ADS} select ad_id from a order by md5(ad_id || '|7'), ad_id limit 100")
def hash_sample(spark, d):
    return once(table(spark, d, "ads", "ad_id"), "ad_id").orderBy(F.md5(F.concat("ad_id", F.lit("|7"))), "ad_id").limit(100)


# ---------------------------------------------------------------- joins and windows


@register(f"with {S.ADS} select ad_id, label from a where ad_id not in (select heading_ad_id from a where heading_ad_id is not null)")
def anti_not_in(spark, d):
    a = once(table(spark, d, "ads", "ad_id", "label", "heading_ad_id"), "ad_id")
    return a.join(a.where("heading_ad_id is not null").select(F.col("heading_ad_id").alias("ad_id")), "ad_id", "left_anti").select("ad_id", "label")


@register(f"with {S.ADS}, {S.DUPS} select newspaper, count(*) as n from a where ad_id in (select dup_cluster_id from d) group by 1")
def semi_in(spark, d):
    a = once(table(spark, d, "ads", "ad_id", "newspaper"), "ad_id")
    return a.join(table(spark, d, "ad_dups").select(F.col("dup_cluster_id").alias("ad_id")), "ad_id", "left_semi").groupBy("newspaper").agg(F.count("*").alias("n"))


@register(f"with {S.ADS} select gender, count(*) as n from (select unnest(positions).gender as gender from a) group by 1")
def lateral_unnest(spark, d):
    return dictionary.position_spans(table(spark, d, "ads")).groupBy("gender").agg(F.count("*").alias("n"))


# The boxes of the data lie anywhere, so every ad with a known heading is laid under it at the gap stated; all others stay.
_LAID = "b as (select a.ad_id, a.newspaper, a.date, a.page, a.label, a.text, coalesce(g.min_x, a.min_x) as min_x, coalesce(g.max_x, a.max_x) as max_x, coalesce(g.max_y + a.heading_gap_px, a.min_y) as min_y, coalesce(g.max_y + a.heading_gap_px + a.max_y - a.min_y, a.max_y) as max_y from a left join a g on g.ad_id = a.heading_ad_id)"
_NEAR = f"""with {S.ADS}, {_LAID}, h as (select * from b where label = 'heading'), r as (select * from b where label is null or label <> 'heading'),
c as (select h.ad_id as h_id, r.ad_id, r.min_y - h.max_y as gap from h join r using (newspaper, date, page)
  where (least(r.max_x, h.max_x) - greatest(r.min_x, h.min_x)) / greatest(h.max_x - h.min_x, 1) >= 0.5 and r.min_y >= h.min_y and r.min_y - h.max_y <= 80),
n as (select * from c qualify row_number() over (partition by h_id order by gap, ad_id) = 1)
select ad_id, h_id as heading_ad_id, gap as heading_gap_px from n qualify row_number() over (partition by ad_id order by gap, h_id) = 1"""


@register(_NEAR)
def nearest_in_column(spark, d):
    a = once(table(spark, d, "ads", "ad_id", "newspaper", "date", "page", "label", "text", "min_x", "max_x", "min_y", "max_y", "heading_ad_id", "heading_gap_px"), "ad_id")
    g = a.select(F.col("ad_id").alias("heading_ad_id"), F.col("min_x").alias("gx"), F.col("max_x").alias("gX"), F.col("max_y").alias("gy"))
    top = F.coalesce(F.col("gy") + F.col("heading_gap_px"), F.col("min_y"))
    laid = a.join(g.toDF("heading_ad_id", "g1", "g2", "g3"), "heading_ad_id", "left").withColumns({"gy": F.col("g3")}).withColumns({"_h": F.col("max_y") - F.col("min_y"), "_top": top})
    laid = laid.select("ad_id", "newspaper", "date", "page", "label", "text", F.coalesce("g1", "min_x").alias("min_x"), F.coalesce("g2", "max_x").alias("max_x"), F.col("_top").alias("min_y"), (F.col("_top") + F.col("_h")).alias("max_y"))
    return link_headings(laid).where("heading_ad_id is not null").select("ad_id", "heading_ad_id", "heading_gap_px")


@register(f"with {S.ADS} select label, count(*) as n, round(100.0 * count(*) / (select count(*) from a where label is not null), 6) as pct from a where label is not null group by 1")
def scalar_subquery_share(spark, d):
    a = once(table(spark, d, "ads", "ad_id", "label"), "ad_id").where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    total = a.agg(F.sum("n").alias("t"))  # one row
    return a.join(F.broadcast(total)).select("label", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


@register(f"with {S.DUPS}, {S.ADS} select dup_cluster_id, count(*) as n, min(date) as first_date, max(date) as last_date, max(date) - min(date) as days from d join a using (ad_id) group by 1")
def cluster_run_dates(spark, d):
    x = once(table(spark, d, "ad_dups", "ad_id", "dup_cluster_id"), "ad_id").join(once(table(spark, d, "ads", "ad_id", "date"), "ad_id"), "ad_id")
    return x.groupBy("dup_cluster_id").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumn("days", F.datediff("last_date", "first_date").cast("long"))


@register(f"with {S.ADS} select newspaper, decade, n from (select newspaper, decade, count(*) as n from a group by all) qualify row_number() over (partition by decade order by n desc, newspaper) <= 5")
def qualify_topn_per_group(spark, d):
    g = once(table(spark, d, "ads", "ad_id", "newspaper", "decade"), "ad_id").groupBy("newspaper", "decade").agg(F.count("*").alias("n"))
    w = Window.partitionBy("decade").orderBy(F.desc("n"), "newspaper")
    return g.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@register("select ad_id, max(loaded_at) as loaded_at, count(*) as deliveries from ads group by ad_id having count(*) > 1")
def latest_per_key(spark, d):
    return table(spark, d, "ads", "ad_id", "loaded_at").groupBy("ad_id").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("deliveries")).where("deliveries > 1")


# ---------------------------------------------------------------- analyst queries


@register(S.CLEAN + "select decade, " + ", ".join(f"round(100.0 * count(*) filter (where label = '{v}') / count(*), 6) as {v}" for v in ("job_offer", "job_search", "service_offer", "vermittlung")) + " from clean where countable group by 1")
def label_share_pivot(spark, d):
    b = base(spark, d).where("countable")
    return b.groupBy("decade").agg(*[F.round(100.0 * F.count_if(F.col("label") == v) / F.count("*"), 6).alias(v) for v in ("job_offer", "job_search", "service_offer", "vermittlung")])


@register(S.CLEAN + "select newspaper, round(avg((position_lemmas is not null)::int), 6) as with_position, round(avg((pay_min is not null)::int), 6) as with_pay from clean where countable group by 1")
def coverage_avg_bool(spark, d):
    m = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")), 6)
    return base(spark, d).where("countable").groupBy("newspaper").agg(m("position_lemmas").alias("with_position"), m("pay_min").alias("with_pay"))


@register(S.CLEAN + "select decade, pay_currency, count(*) as ads, median(pay_min) as median from clean where countable and pay_min is not null group by all having count(*) >= 20")
def pay_quantiles_having(spark, d):
    b = base(spark, d).where("countable and pay_min is not null")
    return b.groupBy("decade", "pay_currency").agg(F.count("*").alias("ads"), F.percentile("pay_min", 0.5).alias("median")).where("ads >= 20")


@register(S.CLEAN + "select position_categories[1] as category, pay_currency, count(*) as ads, median(pay_min) as median from clean where countable and pay_min is not null and len(position_categories) = 1 group by all")
def single_category_pay(spark, d):
    b = base(spark, d).where("countable and pay_min is not null and size(position_categories) = 1")
    return b.groupBy(F.element_at("position_categories", 1).alias("category"), "pay_currency").agg(F.count("*").alias("ads"), F.percentile("pay_min", 0.5).alias("median"))


@register(S.CLEAN + ", g as (select position_gender, count(*) as n_ads from clean where countable and position_gender in ('f', 'm') group by 1), x as (select position_gender, unnest(requirement_tags) as tag from clean where countable and position_gender in ('f', 'm')) select tag, position_gender, count(*) as n, round(100.0 * count(*) / any_value(n_ads), 6) as pct from x join g using (position_gender) group by all")
def tag_share_by_gender(spark, d):
    b = base(spark, d).where("countable and position_gender in ('f', 'm')").select("position_gender", "requirement_tags")
    g = b.groupBy("position_gender").agg(F.count("*").alias("n_ads"))  # two rows
    x = b.select("position_gender", F.explode("requirement_tags").alias("tag")).groupBy("tag", "position_gender").agg(F.count("*").alias("n"))
    return x.join(F.broadcast(g), "position_gender").select("tag", "position_gender", "n", F.round(100.0 * F.col("n") / F.col("n_ads"), 6).alias("pct"))


@register(f"with {S.TEXTS}, {S.ADS} select decade, " + ", ".join(f"count(*) filter (where {f}) as {f}" for f in ("flag_pc_repetition", "flag_pc_expanded", "flag_pc_unsupported", "flag_too_short", "flag_death_register")) + " from t join a using (ad_id) group by 1")
def flags_per_decade(spark, d):
    x = once(table(spark, d, "ad_text"), "ad_id").join(once(table(spark, d, "ads", "ad_id", "decade"), "ad_id"), "ad_id")
    return x.groupBy("decade").agg(*[F.count_if(f).alias(f) for f in ("flag_pc_repetition", "flag_pc_expanded", "flag_pc_unsupported", "flag_too_short", "flag_death_register")])


@register(f"with {S.DUPS} select size, count(*) as clusters from (select dup_cluster_id, count(*) as size from d group by 1) group by 1")
def cluster_size_histogram(spark, d):
    x = table(spark, d, "ad_dups", "ad_id", "dup_cluster_id").distinct().groupBy("dup_cluster_id").agg(F.count("*").alias("size"))
    return x.groupBy("size").agg(F.count("*").alias("clusters"))


# ---------------------------------------------------------------- text


def _ads(spark, d, *columns):
    return once(table(spark, d, "ads", "ad_id", *columns), "ad_id")


@register(f"with {S.ADS} select ad_id, {S.norm('text')} as text_norm from a")
def text_normalize(spark, d):
    return _ads(spark, d, "text").select("ad_id", T.normalize_text(nfc(F.col("text"))).alias("text_norm"))


@register(f"select distinct surface, {S.fold('surface')} as folded from position_dict where surface is not null")
def text_fold(spark, d):
    return table(spark, d, "position_dict", "surface").where("surface is not null").distinct().select("surface", T.fold_spelling(nfc(F.col("surface"))).alias("folded"))


@register(f"with {S.TEXTS}, w as (select ad_id, regexp_extract_all(lower(coalesce(text_norm, '')), '[\\p{{L}}\\p{{N}}_]+') as lw, regexp_extract_all(coalesce(text_norm, ''), '[\\p{{L}}\\p{{N}}_]+') as ow, length(regexp_replace(coalesce(text_norm, ''), '[^\\p{{L}}]', '', 'g')) as n from t), c as (select ad_id, n, " + ", ".join(f"len(list_filter({'lw' if g == 'de' else 'ow'}, lambda x: x in ({', '.join(repr(s) for s in T.STOP_WORDS[g].split('|'))}))) as {g}" for g in ("de", "it", "fr")) + " from w) select ad_id, case when greatest(it, fr) >= 2 and greatest(it, fr) > de then case when it >= fr then 'it' else 'fr' end when de = 0 and n < 10 then 'unknown' else 'de' end as lang from c")
def language_guess(spark, d):
    return once(table(spark, d, "ad_text", "ad_id", "text_norm"), "ad_id").select("ad_id", T.guess_language(F.col("text_norm")).alias("lang"))


@register(f"with {S.ADS}, w as (select ad_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') as w from a), g as (select ad_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) as g from w where len(w) >= 8), c as (select ad_id, g, count(*) as n from g group by all) select ad_id, coalesce(max(n), 0) as repeat_max from w left join c using (ad_id) group by 1")
def ngram_repeat(spark, d):
    return _ads(spark, d, "text").select("ad_id", T.max_ngram_repeat(F.col("text")).cast("long").alias("repeat_max"))


def _plain(x: str) -> str:
    return rf"regexp_replace(lower({S.norm(x)}), '[^a-zäöüß0-9]+', ' ', 'g')"


def _tri(t: str) -> str:
    return f"list_distinct(list_filter(list_transform(range(1, greatest(length({t}) - 1, 2)), lambda i: substr({t}, i, 3)), lambda g: length(g) = 3 and not contains(g, ' ')))"


@register(f"with {S.ADS}, y as (select ad_id, {_plain('text')} as pt, {_plain('text_ocr')} as po from a), x as (select ad_id, {_tri('pt')} as g, {_tri('po')} as o from y) select ad_id, round(case when len(g) = 0 then 1.0 else len(list_intersect(g, o)) / len(g) end, 9) as support from x")
def trigram_support(spark, d):
    a = _ads(spark, d, "text", "text_ocr").select("ad_id", nfc(F.col("text")).alias("t"), nfc(F.col("text_ocr")).alias("o"))
    return a.select("ad_id", F.round(T.ocr_support(F.col("t"), F.col("o")), 9).alias("support"))


@register(f"with {S.ADS}, x as (select ad_id, list_filter(regexp_split_to_array(coalesce(text_ocr, ''), '\\s+'), lambda x: x <> '') as t from a) select ad_id, round(case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: regexp_matches(x, '^[A-Za-zÄÖÜäöüſßéèàçò]{{3,}}[.,;:!?]?$'))) / len(t) end, 9) as share from x")
def wordlike_share(spark, d):
    return _ads(spark, d, "text_ocr").select("ad_id", F.round(T.wordlike_share(F.col("text_ocr")), 9).alias("share"))


@register(f"with {S.ADS} select ad_id, case when regexp_matches(coalesce(text, ''), '{T.SEARCH_VERB}') then 0 else greatest(len(regexp_extract_all(coalesce(text, ''), '{T.DEATH_ENTRY}')), len(regexp_extract_all(coalesce(text, ''), '{T.DEATH_NAME}'))) end as entries from a")
def death_entries(spark, d):
    return _ads(spark, d, "text").select("ad_id", T.death_register_entries(F.col("text")).cast("long").alias("entries"))


@register(f"select form_id, {S.key('surface')} as form_key, {S.key('surface', False)} as phrase_key from (select distinct form_id, surface from position_dict)")
def form_keys(spark, d):
    s = nfc(F.col("surface"))
    return table(spark, d, "position_dict", "form_id", "surface").distinct().select("form_id", T.form_key(s).alias("form_key"), T.form_key(s, enumerations=False).alias("phrase_key"))


@register()
def quality_assess(spark, d):
    return quality.assess(_ads(spark, d, "newspaper", "year", "label", "text", "text_ocr", "heading_text"))


# ---------------------------------------------------------------- dictionaries


_FORMS = f"""with {S.ADS}, m as (
  select {S.key('p.text')} as k, p.text as form, coalesce(p.gender, 'unknown') as gender, 1 as s, 0 as h from (select unnest(positions) as p from a)
  union all select {S.key('heading_text')}, heading_text, null, 0, 1 from a where heading_text is not null),
f as (select k, form, sum(s) as s, sum(h) as h from m where k <> '' group by all)
select k as "key", cast(sum(s) as int) as n_spans, cast(sum(h) as int) as n_headings, cast(sum(s) + sum(h) as int) as "count", arg_min(form, (-s, -h, form)) as form from f group by k"""


@register(_FORMS.replace("arg_min(form, (-s, -h, form)) as form", f"regexp_replace({S.norm('arg_min(form, (-s, -h, form))')}, '^[ .,;:-]+|[ .,;:-]+$', '', 'g') as surface"))
def distinct_forms(spark, d):
    ads = table(spark, d, "ads")
    heads = ads.where("heading_text is not null").select("ad_id", F.col("heading_text").alias("heading")).dropDuplicates(["ad_id"])
    return dictionary.collect_forms(dictionary.position_spans(ads), heads).select("key", "n_spans", "n_headings", "count", "surface")


_PHRASES = f"""with {S.ADS}, {S.REQUIREMENTS}, k as (select *, {S.key('phrase', False)} as phrase_key from phrases where ad_id not in (select ad_id from ad_text where flag_death_register and ad_id is not null)),
f as (select * from k where phrase_key <> '' qualify row_number() over (partition by "column", phrase_key, ad_id order by span_start, span_end, year, phrase) = 1),
r as (select *, count(*) over (partition by "column", phrase_key) as n, row_number() over (partition by "column", phrase_key order by year, ad_id) as rn from f)
select "column", phrase_key, cast(max(n) as int) as "count", string_agg({S.snippet('text', 'span_start', 'span_end', 50)}, ' ‖ ' order by rn) as context
from r where (n < 3 and rn = n // 2 + 1) or (n >= 3 and rn in (1, n // 2 + 1, n)) group by all"""


@register(_PHRASES)
def contexts_first_mid_last(spark, d):
    return dictionary.collect_phrases(dictionary.requirement_spans(table(spark, d, "ads"), ad_text=table(spark, d, "ad_text", "ad_id", "flag_death_register"))).select("column", "phrase_key", "count", "context")


_E = 'e as (select form_id, coalesce("count", 1) as c, x.lemma, x.category from (select form_id, "count", unnest(entries) as x from pp)), pp as (select * from position_dict qualify row_number() over (partition by form_id) = 1)'
_E = 'pp as (select * from position_dict qualify row_number() over (partition by form_id order by form_id) = 1), ' + _E.rsplit(", pp as", 1)[0]


@register(f"with {_E}, v as (select lower(lemma) as low, category, sum(c) as n from e where lemma is not null group by all), t as (select low, arg_min(category, (-n, category)) as dominant, max(n) as m, sum(n) as total from v group by 1) select form_id, lemma, category, coalesce(case when m >= 0.75 * total then dominant end, category) as harmonized from e left join t on low = lower(lemma)")
def harmonize_category(spark, d):
    return dictionary.harmonize_categories(once(table(spark, d, "position_dict"), "form_id")).select("form_id", "lemma", "category", "harmonized")


@register(f"with {_E} select lemma, count(distinct category) as n_categories from e where lemma is not null group by 1 having count(distinct category) > 1")
def form_conflicts(spark, d):
    return dictionary.form_conflicts(once(table(spark, d, "position_dict"), "form_id"))


@register(f"with q as (select * from requirement_dict qualify row_number() over (partition by req_id order by req_id) = 1), t as (select req_id, surface, t.dimension, t.value from (select req_id, surface, unnest(tags) as t from q) where t.value is not null), w as (select *, regexp_extract_all(lower({S.norm('value')}), '\\p{{L}}{{4,}}|[0-9]{{2,}}') as ws, {S.fold('surface')} as p from t) select req_id, dimension, value from w where len(ws) > 0 and len(list_filter(ws, lambda x: contains(p, {S.fold('x', True)}))) = 0")
def verification_candidates(spark, d):
    return dictionary.verification_candidates(table(spark, d, "requirement_dict")).select("req_id", "dimension", "value")


@register("select phrase as snippet, count(*) as n, min(year) as first_year from ad_salary where amount_min is null group by 1")
def leftovers(spark, d):
    return table(spark, d, "ad_salary", "phrase", "amount_min", "year").where("amount_min is null").groupBy(F.col("phrase").alias("snippet")).agg(F.count("*").alias("n"), F.min("year").alias("first_year"))


# ---------------------------------------------------------------- duplicates


@register(f"with {S.TEXTS} select newspaper, md5(text_norm) as h, count(*) as n, min(ad_id) as first_id from t where text_norm is not null group by all having count(*) > 1")
def exact_dups(spark, d):
    t = once(table(spark, d, "ad_text", "ad_id", "newspaper", "text_norm"), "ad_id").where("text_norm is not null")
    return t.groupBy("newspaper", F.md5("text_norm").alias("h")).agg(F.count("*").alias("n"), F.min("ad_id").alias("first_id")).where("n > 1")


@register()
def dup_clusters(spark, d):
    t = once(table(spark, d, "ad_text"), "ad_id").select("ad_id", "newspaper", "year", "text_norm", "n_flags", "ocr_support", "flag_pc_unsupported", "flag_too_short", "flag_death_register")
    a = once(table(spark, d, "ads", "ad_id", "date", "label"), "ad_id")
    ok = ~F.coalesce("flag_pc_unsupported", F.lit(False)) & ~F.coalesce("flag_too_short", F.lit(False)) & ~F.coalesce("flag_death_register", F.lit(False)) & ~F.col("label").eqNullSafe("heading")
    r = t.join(a, "ad_id").select("ad_id", "newspaper", "year", "date", F.coalesce("text_norm", F.lit("")).alias("text_norm"), ok.alias("eligible"), F.coalesce("n_flags", F.lit(9).cast("byte")).alias("n_flags"), F.coalesce("ocr_support", F.lit(0.0).cast("float")).alias("ocr_support"))
    return dedup.deduplicate(r)


@register(f"""with recursive {S.DUPS}, e as (select ad_id as u, dup_cluster_id as v from d where ad_id is not null and dup_cluster_id is not null),
b as (select u, v from e union select v, u from e), r(node, reach) as (select u, u from b union select r.node, b.v from r join b on b.u = r.reach) select node, min(reach) as component from r group by 1""")
def components_from_edges(spark, d):
    return components(table(spark, d, "ad_dups", "ad_id", "dup_cluster_id"), "ad_id", "dup_cluster_id")


# ---------------------------------------------------------------- amounts


@register()
def amounts_parse(spark, d):
    """Every salary span of the ads read by rules."""
    return amounts.parse_spans(amounts.salary_spans(table(spark, d, "ads"))).drop("snippet")


@register(f"with {S.ADS}, p as (select lower({S.norm('x.text')}) as t from (select unnest(salary) as x from a)) select count(*) as spans, count(*) filter (where regexp_matches(t, '[0-9]')) as with_number, count(*) filter (where regexp_matches(t, '^[^a-zäöüß0-9]*[0-9]+ ?(?:gulden|kronen|mark|schilling)')) as spelled_out from p")
def amount_spans(spark, d):
    t = F.lower(T.normalize_text(nfc(F.col("phrase"))))
    s = amounts.salary_spans(table(spark, d, "ads")).select(t.alias("t"))
    return s.agg(F.count("*").alias("spans"), F.count_if(F.col("t").rlike("[0-9]")).alias("with_number"), F.count_if(F.col("t").rlike("^[^a-zäöüß0-9]*[0-9]+ ?(?:gulden|kronen|mark|schilling)")).alias("spelled_out"))


# ---------------------------------------------------------------- tools


def _tool_index(spark, d):
    return index.rows(base(spark, d)).select("ad_id", "dup_cluster_id", "countable", "words")


_WORDS = rf"regexp_extract_all({S.fold('text_norm')}, '[\p{{L}}\p{{N}}]+')"
_TOOL = S.CLEAN + f", ix as (select ad_id, dup_cluster_id, countable, {_WORDS} as words from clean where searchable)"


def _scored(terms: list[str], condition: str) -> str:
    one = " + ".join(f"ln(1 + (n - df_{i} + 0.5) / (df_{i} + 0.5)) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * len(words) / greatest(mean, 1.0)))" for i in range(len(terms)))
    dfs = ", ".join(f"count(*) filter (where list_contains(words, '{t}')) as df_{i}" for i, t in enumerate(terms))
    tfs = ", ".join(f"len(list_filter(words, lambda w: w = '{t}')) as tf_{i}" for i, t in enumerate(terms))
    return f", st as (select count(*) as n, avg(len(words)) as mean, {dfs} from ix), hits as (select ad_id, dup_cluster_id, countable, {one} as score from (select *, {tfs} from ix where {condition}) cross join st)"


@register(_TOOL + _scored(["freie", "wohnung"], "contains(' ' || array_to_string(words, ' ') || ' ', ' freie wohnung ')") + "select ad_id, dup_cluster_id, round(score, 6) as score, countable from hits qualify row_number() over (partition by coalesce(dup_cluster_id, ad_id) order by score desc, ad_id) = 1")
def tool_search_ads(spark, d):
    """search_ads: all matches of a phrase, ranked by BM25, one per printing cluster."""
    hits = index.best_printings(index.ranked(_tool_index(spark, d), '"freie Wohnung"'))
    return hits.select("ad_id", "dup_cluster_id", F.round("score", 6).alias("score"), "countable")


@register(_TOOL + ", kw as (select distinct dup_cluster_id from ix where list_contains(words, 'wohnung')) select decade as g, count(distinct ad_id) as n from clean where countable and dup_cluster_id in (select dup_cluster_id from kw) group by 1")
def agg_keyword(spark, d):
    """aggregate with a keyword: countable printings of the clusters that match."""
    b = base(spark, d)
    kept = tools.restricted(b, index.rows(b).select("dup_cluster_id", "words"), "Wohnung")
    return aggregate(kept, AggregateSpec(group_by="decade"))


_CONCEPT = S.fold_query("Koch")


@register(S.CLEAN + f", c as (select ap.* from ap join clean using (ad_id) where countable), l as (select distinct lemma from c where lemma is not null and (contains(coalesce({S.fold('lemma')}, ''), '{_CONCEPT}') or contains(coalesce({S.fold('modern')}, ''), '{_CONCEPT}') or contains(coalesce({S.fold('term')}, ''), '{_CONCEPT}'))) select lemma, count(distinct ad_id) as n_ads from c where lemma in (select lemma from l) group by 1")
def tool_expand_lemmas(spark, d):
    return tools.concept_lemmas(dictionary.ad_positions(table(spark, d, "ads"), table(spark, d, "position_dict")), base(spark, d), "Koch")


@register(S.CLEAN + f"select dimension, value, count(distinct ad_id) as n_ads from ar join clean using (ad_id) where countable and value is not null and contains({S.fold('value')}, '{S.fold_query('bügeln')}') group by all")
def tool_expand_tags(spark, d):
    r = dictionary.ad_requirements(table(spark, d, "ads"), table(spark, d, "requirement_dict"), table(spark, d, "ad_text", "ad_id", "flag_death_register"))
    return tools.concept_tags(r, base(spark, d), "bügeln")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
