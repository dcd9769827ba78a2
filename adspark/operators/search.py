"""Keyword search, BM25, exact and bucketed vector search, rank fusion."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspark.functions.text import fold_query, index_words, search_tokens

K1, B, RRF_K, MOST_EXPANSIONS = 1.2, 0.75, 60, 100


# ---------------------------------------------------------------- keywords


@dataclass(frozen=True)
class Part:
    must: bool
    kind: str  # word, phrase, prefix
    words: tuple[str, ...]
    group: int


def parse_keywords(q: str) -> list[Part]:
    """words, "phrases", prefix*, OR groups and -exclusions; a hyphenated token is a phrase, a leading OR is ignored."""
    parts: list[Part] = []
    joined = False
    for token in re.findall(r'-?"[^"]*"|\S+', q):
        quoted = token.lstrip("-").startswith('"')
        if token == "OR":
            joined = bool(parts)
            continue
        minus = token.startswith("-")
        body = token[1:] if minus else token
        ws = tuple(re.findall(r"[^\W_]+", fold_query(body)))
        if not ws:
            continue
        kind = "phrase" if len(ws) > 1 else "prefix" if body.endswith("*") and not quoted else "word"
        group = 0 if not parts else parts[-1].group + (not joined)
        parts.append(Part(parts[-1].must if joined else not minus, kind, ws, group))
        joined = False
    return parts


def vocabulary(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents each word stands. Pre-aggregated map-side."""
    return index.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def expand(vocab: DataFrame, prefix: str, most: int = MOST_EXPANSIONS) -> DataFrame:
    """The most frequent words that begin with the prefix; ties by word. `most` is the expansion limit of a query."""
    return vocab.where(F.col("term").startswith(prefix)).orderBy(F.desc("df"), "term").limit(most)


def keyword_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): folded words in order; the positional index that phrases are matched against."""
    return docs.select(key, index_words(F.col(text)).alias("words"))


def keyword_condition(q: str, expansions: dict[str, list[str]]) -> Column | None:
    """The match condition over `words`; None if a prefix that must occur stands for no word."""
    parts = parse_keywords(q)
    if not any(p.must for p in parts):
        raise ValueError(f"no word that must occur in {q!r}")
    padded = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    conditions = []
    for g in sorted({p.group for p in parts}):
        group = [p for p in parts if p.group == g]
        options: list[Column] = []
        for p in group:
            if p.kind == "prefix":
                terms = expansions.get(p.words[0], [])
                options += [F.arrays_overlap("words", F.array(*map(F.lit, terms)))] if terms else []
            elif p.kind == "phrase":
                options.append(padded.contains(" " + " ".join(p.words) + " "))
            else:
                options.append(F.array_contains("words", p.words[0]))
        if not options:
            if group[0].must:
                return None
            continue
        hit = reduce(lambda a, b: a | b, options)
        conditions.append(hit if group[0].must else ~hit)
    return reduce(lambda a, b: a & b, conditions)


def keyword(index: DataFrame, q: str, vocab: DataFrame | None = None) -> DataFrame:
    """Documents that match a keyword query. Prefixes are expanded first (at most 100 words reach the driver for each)."""
    prefixes = {p.words[0] for p in parse_keywords(q) if p.kind == "prefix"}
    v = vocab if vocab is not None else vocabulary(index) if prefixes else None
    expansions = {p: [r["term"] for r in expand(v, p).collect()] for p in sorted(prefixes)} if v is not None else {}
    c = keyword_condition(q, expansions)
    return index.where(F.lit(False) if c is None else c)


def keyword_terms(q: str, vocab: DataFrame) -> list[str]:
    """The words of a query by which its matches are ranked: all but those of exclusions, prefixes as the words they stand for."""
    out: list[str] = []
    for p in parse_keywords(q):
        if p.must:
            out += [r["term"] for r in expand(vocab, p.words[0]).collect()] if p.kind == "prefix" else p.words
    return list(dict.fromkeys(out))


# ---------------------------------------------------------------- BM25


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): one row per term and document."""
    t = docs.select(key, search_tokens(F.col(text)).alias("t"))
    return t.select(key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """(query_id, key, score, rank): the k best documents per query with a positive score; ties by key.

    Only postings of query terms are scored: they are joined with the queries' terms before lengths and document frequencies
    come in, and the k best are cut inside each partition first (a window group limit).
    """
    tokens = docs.select(key, search_tokens(F.col(text)).alias("t"))
    stats = tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("mean"))  # one row
    terms = queries.select("query_id", F.explode(F.array_distinct(search_tokens(F.col("question")))).alias("term"))
    p = postings(docs, key, text).join(terms.select("term").distinct(), "term", "left_semi")
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest("mean", F.lit(1.0))))
    scored = p.join(df.join(F.broadcast(stats)), "term").select("term", key, weight.alias("w"))
    s = scored.join(terms, "term").groupBy("query_id", key).agg(F.sum("w").alias("score")).where("score > 0")
    return _best(s, key, k)


def _best(scored: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- vectors


def truncate(vector: Column, dims: int) -> Column:
    """The first dims numbers, renormalized (norms under 1e-12 count as that)."""
    v = F.transform(F.slice(vector, 1, dims), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


QUERY_BLOCK = 2048  # queries that a task multiplies with its documents at a time


def dense(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): exact top k by inner product; with `group`, of the best document of each group.

    Queries and documents stay in Spark: documents lie in parts, queries in blocks, and every (part, block) is one task that
    multiplies them and keeps its k best per query (or the best per query and group), so what is shuffled afterwards are k rows
    per query and part. The number of parts grows with the documents, that of blocks with the queries; nothing reaches the
    driver but their counts.
    """
    s = docs.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = max(1, -(-s.sparkContext.defaultParallelism // blocks))
    d = docs.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_v"), (F.col(group) if group else F.lit(None)).cast("string").alias("_g"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"))
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    q = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("_q"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))

    def best(doc: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(doc) or not len(ask):
            return pd.DataFrame({"query_id": [], "key": [], "score": [], "grp": []})
        ids, keys = ask["query_id"].to_numpy(np.int64), doc["_k"].to_numpy(np.int64)
        order = np.argsort(keys, kind="stable")  # of equal scores the smaller key comes first
        keys, groups = keys[order], doc["_g"].to_numpy(object)[order]
        v, qs = np.array(doc["_v"].tolist(), np.float64)[order], np.array(ask["_q"].tolist(), np.float64)
        codes = pd.factorize(pd.Series(groups).fillna("\x00"))[0] if group else None
        out = []
        for at in range(0, len(ids), 256):
            scores = qs[at : at + 256] @ v.T
            ranked = np.argsort(-np.round(scores, 9), axis=1, kind="stable")
            for i, row in enumerate(ranked):
                if group:
                    _, first = np.unique(codes[row], return_index=True)
                    row = row[np.sort(first)]
                row = row[:k]
                out.append(pd.DataFrame({"query_id": ids[at + i], "key": keys[row], "score": scores[i, row], "grp": groups[row]}))
        return pd.concat(out)

    got = d.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInPandas(best, "query_id long, key long, score double, grp string")
    if group:
        top = F.min(F.struct((-F.round("score", 9)).alias("s"), "key", "score")).alias("x")
        got = got.groupBy("query_id", "grp").agg(top).select("query_id", "x.key", "x.score", "grp")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    out = got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("key").alias(key), "score", "rank", *([F.col("grp").alias(group)] if group else []))


def rrf(rankings: DataFrame, key: str, k: int = 10, constant: int = RRF_K) -> DataFrame:
    """Fused ranking of lists (query_id, method, key, rank): sum of 1/(constant + rank); ties by key."""
    s = rankings.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def one_per_cluster(hits: DataFrame, cluster: str, key: str, k: int) -> DataFrame:
    """The best hit of every (query, cluster), then the k best of a query."""
    w = Window.partitionBy("query_id", cluster).orderBy(F.desc("score"), key)
    first = hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return _best(first.drop("rank") if "rank" in first.columns else first, key, k)


def signed_buckets(vector: Column, planes: np.ndarray, tables: int) -> Column:
    """One bucket number per table: the signs of the vector's products with the table's random planes, as bits."""
    bits = len(planes) // tables

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def codes(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        up = (np.array(v.tolist(), float) @ planes.T > 0).reshape(len(v), tables, bits)
        return pd.Series(list((up * (1 << np.arange(bits))).sum(2) + np.arange(tables) * (1 << bits)))

    return codes(vector)


def approximate(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", tables: int = 24, bits: int = 4, seed: int = 3) -> DataFrame:
    """Top k among documents that share a bucket with the query in any table, re-ranked exactly. Every row is indexed."""
    first = docs.select(F.size(vector).alias("n")).where("n > 0").first()
    dims = first["n"] if first else 1
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dims))
    d = docs.select(key, vector, F.explode(signed_buckets(F.col(vector), planes, tables)).alias("bucket"))
    q = queries.select("query_id", F.col(vector).alias("qv"), F.explode(signed_buckets(F.col(vector), planes, tables)).alias("bucket"))
    pairs = d.select(key, "bucket").join(q.select("query_id", "bucket"), "bucket").select("query_id", key).distinct()
    product = F.aggregate(F.zip_with(vector, "qv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    s = pairs.join(docs.select(key, vector), key).join(queries.select("query_id", F.col(vector).alias("qv")), "query_id").select("query_id", key, product.alias("score"))
    return _best(s, key, k)
