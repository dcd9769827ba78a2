"""The stored search index: folded words and filter columns of every ad, and word lists, replaced newspaper by newspaper."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.operators.search import B, K1, keyword, keyword_terms, vocabulary
from adspark.functions.text import index_words
from adspark.sources.tables import write_partitioned


def rows(clean: DataFrame, text: str = "text_norm") -> DataFrame:
    """What is indexed of the clean table: its searchable ads with their words in order. Expects normalized text."""
    return clean.where("searchable").withColumn("words", index_words(F.col(text))).withColumn("n_words", F.size("words"))


@dataclass
class Index:
    """A stored index: `ads` (one row per ad) and `vocab` (newspaper, term, df), both partitioned by newspaper."""

    spark: SparkSession
    path: str

    def replace(self, ads: DataFrame) -> None:
        """Write ads with their words; only the newspapers in them are replaced."""
        write_partitioned(ads.select(*[c for c in ads.columns if c != "newspaper"], "newspaper"), f"{self.path}/ads", by=("newspaper",))
        v = ads.select("newspaper", F.explode(F.array_distinct("words")).alias("term")).groupBy("newspaper", "term").agg(F.count("*").alias("df"))
        write_partitioned(v.select("term", "df", "newspaper"), f"{self.path}/vocab", by=("newspaper",))

    @property
    def ads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ads")

    @property
    def vocab(self) -> DataFrame:
        """The word lists of all newspapers, merged by sum."""
        return self.spark.read.parquet(f"{self.path}/vocab").groupBy("term").agg(F.sum("df").alias("df"))


def occurrences(term: str) -> Column:
    return F.size(F.filter("words", lambda w: w == term)).cast("double")


def ranked(index: DataFrame, q: str, vocab: DataFrame | None = None) -> DataFrame:
    """Matches of a keyword query with their BM25 score over the query's words that must or may occur.

    One pass finds how many documents hold each word and how long documents are (as many numbers as the query has words reach
    the driver), a second scores the matches with JVM expressions. Words of exclusions do not score.
    """
    v = vocab if vocab is not None else vocabulary(index)
    terms = keyword_terms(q, v)
    held = index.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), *[F.count_if(F.array_contains("words", t)).alias(f"df_{i}") for i, t in enumerate(terms)]).first()
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = occurrences(t)
        idf = F.log(F.lit(1 + (held["n"] - held[f"df_{i}"] + 0.5) / (held[f"df_{i}"] + 0.5)))
        norm = K1 * (1 - B + B * F.size("words") / F.lit(max(held["mean"] or 0.0, 1.0)))
        score = score + idf * tf * (K1 + 1) / (tf + norm)
    return keyword(index, q, v).withColumn("score", score)


def best_printings(hits: DataFrame, cluster: str = "dup_cluster_id", key: str = "ad_id") -> DataFrame:
    """The best hit of every cluster, by aggregation: score, then the smaller key; hits without a cluster stand alone."""
    rest = [c for c in hits.columns if c not in (cluster, key, "score")]
    own = F.coalesce(F.col(cluster), F.col(key))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.struct(cluster, *rest).alias("x")))
    return hits.groupBy(own.alias("_c")).agg(best.alias("b")).select(F.col("b.k").alias(key), (-F.col("b.s")).alias("score"), "b.x.*")
