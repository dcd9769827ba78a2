"""Registered queries for search, vectors, evaluation, logs and the star schema, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adspark.functions import text as T
from adspark.operators import evaluate, feedback, search
from adspark.plans import sql as S
from adspark.runtime import once, table

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


def _texts(spark, d):
    return once(table(spark, d, "ad_text", "ad_id", "text_norm"), "ad_id")


def _index(spark, d):
    return search.keyword_index(_texts(spark, d), "ad_id", "text_norm")


_W = rf"regexp_extract_all({S.fold('text_norm')}, '[\p{{L}}\p{{N}}]+')"
_IX = f"with {S.TEXTS}, ix as (select ad_id, {_W} as words, ' ' || array_to_string({_W}, ' ') || ' ' as padded from t)"


@register(f"{_IX} select ad_id from ix where list_contains(words, 'hiesigen') and list_contains(words, '{T.fold_query('Geschäfte')}')")
def keyword_and(spark, d):
    return search.keyword(_index(spark, d), "hiesigen Geschäfte").select("ad_id")


@register(f"{_IX} select ad_id from ix where contains(padded, ' {T.fold_query('freie wohnung')} ')")
def keyword_phrase(spark, d):
    return search.keyword(_index(spark, d), '"freie Wohnung"').select("ad_id")


@register(f"{_IX} select ad_id from ix where (list_contains(words, '{T.fold_query('Koch')}') or list_contains(words, '{T.fold_query('Köchin')}')) and not list_contains(words, 'lohn')")
def keyword_or_exclude(spark, d):
    return search.keyword(_index(spark, d), "Koch OR Köchin -Lohn").select("ad_id")


_V = "v as (select term, count(*) as df from (select distinct ad_id, unnest(words) as term from ix) group by 1), e as (select term from v where starts_with(term, 'gart') order by df desc, term limit 100)"


@register(f"{_IX}, {_V} select ad_id from ix where list_has_any(words, (select list(term) from e))")
def keyword_prefix(spark, d):
    return search.keyword(_index(spark, d), "Gart*").select("ad_id")


@register(f"{_IX}, {_V} select term, df from v")
def token_df_vocab(spark, d):
    return search.vocabulary(_index(spark, d))


@register(f"{_IX}, {_V} select term from e")
def prefix_expand(spark, d):
    return search.expand(search.vocabulary(_index(spark, d)), "gart").select("term")


_BM = f"""with {S.TEXTS}, dt as (select ad_id, {S.tokens('text_norm')} as t from t), st as (select count(*) as n_docs, avg(len(t)) as mean from dt),
q as (select distinct item_id as query_id, unnest({S.tokens('text')}) as term from (select * from eval_items where kind = 'question')),
p as (select ad_id, len(t) as length, term, count(*) as tf from (select ad_id, t, unnest(t) as term from dt) where term in (select term from q) group by ad_id, len(t), term),
f as (select term, count(*) as df from p group by 1),
s as (select query_id, ad_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / greatest(mean, 1.0)))) as score from p join f using (term) cross join st join q using (term) group by all)
select query_id, ad_id, round(score, 6) as score from s qualify row_number() over (partition by query_id order by score desc, ad_id) <= 10"""


def _questions(spark, d):
    return table(spark, d, "eval_items").where("kind = 'question'").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@register(_BM)
def bm25_topk(spark, d):
    return search.bm25(_texts(spark, d), _questions(spark, d), "ad_id", "text_norm").select("query_id", "ad_id", F.round("score", 6).alias("score"))


_SHARE = "case when len(ws) = 0 then 0.0 else cast(round(cast(len(list_filter(ws, lambda w: contains(tx, w))) / len(ws) as decimal(20,10)), 2) as double) end"


@register(_BM.replace("select query_id, ad_id, round(score, 6) as score from s qualify", ", h as (select query_id, ad_id from s qualify", 1) + f""") select query_id, ad_id, {_SHARE} as share from (
  select h.query_id, h.ad_id, regexp_extract_all(lower(i.text), '\\p{{L}}{{6,}}') as ws, lower(coalesce(t.text_norm, '')) as tx from h join eval_items i on i.item_id = h.query_id join t using (ad_id))""")
def verbatim_questions(spark, d):
    hits = search.bm25(_texts(spark, d), _questions(spark, d), "ad_id", "text_norm").select("query_id", "ad_id")
    j = hits.join(_questions(spark, d), "query_id").join(_texts(spark, d), "ad_id")
    return j.select("query_id", "ad_id", T.verbatim_share(F.col("question"), F.col("text_norm")).alias("share"))


# ---------------------------------------------------------------- vectors and evaluation: queries are the ids divisible by 20


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_DOT = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: cast(q.embedding[i] as double) * cast(v.embedding[i] as double)))"
_TOP = f"s as (select q.vec_id as query_id, v.vec_id, v.label, {_DOT} as score from (select * from embeddings where vec_id % 20 = 0) q cross join embeddings v), r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s)"


@register(f"with {_TOP} select query_id, vec_id, rank, round(score, 6) as score from r where rank <= 10")
def dense_topk(spark, d):
    v, q = _vectors(spark, d)
    return search.dense(v, q).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@register(f"with {_TOP.replace('cross join embeddings v', 'cross join (select * from embeddings where label in (1, 3)) v')} select query_id, vec_id, rank from r where rank <= 10")
def knn_prefilter(spark, d):
    v, q = _vectors(spark, d)
    return search.dense(v.where("label in (1, 3)"), q).select("query_id", "vec_id", "rank")


@register("with t as (select vec_id, list_transform(embedding[1:16], lambda x: cast(x as double)) as v from embeddings) select vec_id, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) as first, round(v[16] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) as last from t")
def truncate_renorm(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", search.truncate(F.col("embedding"), 16).alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 16), 6).alias("last"))


@register(f"with {_TOP}, o as (select query_id, vec_id, row_number() over (partition by query_id order by label, vec_id) as rank from r where rank <= 50), u as (select query_id, vec_id, rank from r where rank <= 50 union all select * from o), f as (select query_id, vec_id, sum(1.0 / (60 + rank)) as score from u group by all) select query_id, vec_id, row_number() over (partition by query_id order by round(score, 12) desc, vec_id) as rank from f qualify row_number() over (partition by query_id order by round(score, 12) desc, vec_id) <= 10")
def rrf_fusion(spark, d):
    v, q = _vectors(spark, d)
    a = search.dense(v, q, k=50).select("query_id", "vec_id", "rank")
    b = a.join(v.select("vec_id", "label"), "vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("label", "vec_id"))).select("query_id", "vec_id", "rank")
    return search.rrf(a.unionByName(b), "vec_id").select("query_id", "vec_id", "rank")


@register()
def approximate_topk(spark, d):
    v, q = _vectors(spark, d)
    return search.approximate(v, q)


@register(f"with {_TOP}, c as (select *, row_number() over (partition by query_id, label order by score desc, vec_id) as k from r) select query_id, vec_id, label from c where k = 1")
def one_hit_per_cluster(spark, d):
    v, q = _vectors(spark, d)
    hits = search.dense(v, q, k=1000, group="label")  # more than there are labels: the labels cut the list, not k
    return hits.select("query_id", "vec_id", F.col("label").cast("long").alias("label"))


def _judged(spark, d):
    v, q = _vectors(spark, d)
    runs = search.dense(v, q).withColumn("method", F.lit("dense")).unionByName(search.dense(v, q, k=40).where("rank % 4 = 0").withColumn("rank", (F.col("rank") / 4).cast("int")).withColumn("method", F.lit("sparse")))
    runs = runs.select("query_id", "method", "rank", F.col("vec_id").alias("ad_id"))
    labels = q.select("query_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    j = runs.select("query_id", "ad_id").distinct().join(labels, "query_id").join(v.select(F.col("vec_id").alias("ad_id"), "label"), "ad_id")
    grade = F.when(F.col("label") == F.col("own"), 2).when(F.abs(F.col("label") - F.col("own")) == 1, 1).otherwise(0)
    return runs, j.select("query_id", "ad_id", F.col("ad_id").alias("cluster"), grade.alias("grade"))


_IR = f"""with {_TOP}, runs as (select query_id, 'dense' as method, rank, vec_id as ad_id from r where rank <= 10 union all select query_id, 'sparse', cast(rank / 4 as int), vec_id from r where rank <= 40 and rank % 4 = 0),
j as (select distinct x.query_id, x.ad_id, case when a.label = o.label then 2 when abs(a.label - o.label) = 1 then 1 else 0 end as grade from runs x join embeddings a on a.vec_id = x.ad_id join embeddings o on o.vec_id = x.query_id),
ideal as (select query_id, sum(case grade when 2 then 3.0 when 1 then 1.0 else 0 end / log2(i + 1)) as ideal from (select *, row_number() over (partition by query_id order by grade desc, ad_id) as i from j) where i <= 10 group by 1),
rel as (select query_id, count(*) filter (where grade = 2) as n_rel from j group by 1),
sc as (select query_id, method, count(*) filter (where grade = 2) / 10 as p10, count(*) filter (where grade >= 1) / 10 as p10_lenient, sum(case grade when 2 then 3.0 when 1 then 1.0 else 0 end / log2(rank + 1)) as dcg, count(*) filter (where grade = 2) as hits from runs join j using (query_id, ad_id) where rank <= 10 group by all),
per as (select query_id, method, p10, p10_lenient, case when coalesce(ideal, 0) > 0 then dcg / ideal else 0.0 end as ndcg10, case when n_rel > 0 then hits / n_rel end as recall from sc left join ideal using (query_id) left join rel using (query_id))"""


@register(_IR + " select query_id, method, round(p10, 6) as p10, round(p10_lenient, 6) as p10_lenient, round(ndcg10, 6) as ndcg10, round(recall, 6) as recall from per")
def ir_scores(spark, d):
    s = evaluate.scores(*_judged(spark, d))
    return s.select("query_id", "method", *[F.round(c, 6).alias(c) for c in ("p10", "p10_lenient", "ndcg10", "recall")])


@register(_IR + " select method, " + ", ".join(f"cast(round(cast(avg({c}) as decimal(20,10)), 3) as double) as {c}" for c in ("p10", "p10_lenient", "ndcg10", "recall")) + " from per group by 1")
def ir_summary(spark, d):
    return evaluate.summary(evaluate.scores(*_judged(spark, d)))


@register()
def paired_interval(spark, d):
    return evaluate.paired_bootstrap(evaluate.scores(*_judged(spark, d)), "ndcg10", "dense", "sparse")


@register(f"with {S.ADS}, z as (select decade, count(*) as size from a group by 1), al as (select decade, cast(greatest(round(cast(300 * sqrt(size) / (select sum(sqrt(size)) from z) as decimal(20,10))), 1) as int) as take from z) select ad_id, decade from a join al using (decade) qualify row_number() over (partition by decade order by md5(ad_id || '|0'), ad_id) <= take")
def stratified_seeds(spark, d):
    return evaluate.stratified(once(table(spark, d, "ads", "ad_id", "decade"), "ad_id"), "decade", "ad_id", 300)


# ---------------------------------------------------------------- logs


@register("select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint)) as k from events group by 1")
def jsonl_props(spark, d):
    e = table(spark, d, "events", "event_type", "props").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@register("""with answers as (select c_custkey as answer_id, c_mktsegment from customer), r as (select user_id as answer_id, event_type as rated_by, ts as rated_at, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1)
select answer_id, c_mktsegment, rated_by, event_id, value from answers left join r using (answer_id)""")
def latest_rating_join(spark, d):
    """Customers play the answers, their events the ratings: one row per answer and rater, answers nobody rated stay."""
    ratings = table(spark, d, "events").select(F.col("user_id").alias("answer_id"), F.col("event_type").alias("user"), F.col("ts").alias("time"), "event_id", "value")
    answers = table(spark, d, "customer").select(F.col("c_custkey").alias("answer_id"), "c_mktsegment")
    return feedback.interactions(answers, ratings).select("answer_id", "c_mktsegment", "rated_by", "event_id", "value")


@register(f"with {S.DUPS} select newspaper, sum(len(regexp_extract_all(coalesce(dup_cluster_id, ''), '\\b[a-z]+_[0-9]{{8}}_[0-9]{{3}}_region_[0-9]{{4}}\\b'))) as cited, count(*) filter (where dup_cluster_id <> ad_id) as foreign_ids from d group by 1")
def citations_check(spark, d):
    x = once(table(spark, d, "ad_dups", "ad_id", "newspaper", "dup_cluster_id"), "ad_id")
    return x.groupBy("newspaper").agg(F.sum(F.size(T.citations(F.col("dup_cluster_id")))).alias("cited"), F.count_if(F.size(F.array_except(T.citations(F.col("dup_cluster_id")), F.array("ad_id"))) > 0).alias("foreign_ids"))


# ---------------------------------------------------------------- star schema


@register("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_quantity), 4) as avg_qty, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2")
def tpch_q1(spark, d):
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate <= date '1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@register("select o_orderkey, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15' group by 1")
def tpch_q3(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").where("o_orderdate < date '1998-03-15'")
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate > date '1998-03-15'")
    j = li.join(o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
