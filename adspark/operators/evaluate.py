"""Retrieval evaluation: pooling, graded scores, summaries, stratified samples, paired bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 10


def pool(runs: DataFrame) -> DataFrame:
    """Distinct (query, document, cluster) found by any method."""
    return runs.select("query_id", "ad_id", "cluster").distinct()


def unjudged(pooled: DataFrame, judgments: DataFrame) -> DataFrame:
    return pooled.join(judgments, ["query_id", "ad_id"], "left_anti")


def extend(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs with the methods of `new` replaced by their new lists."""
    return runs.join(new.select("method").distinct(), "method", "left_anti").unionByName(new)


def scores(runs: DataFrame, judgments: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per (query, method): precision (grade 2), lenient precision, nDCG (gains 0/1/3), recall (NULL without relevant clusters).

    Grades count per document, relevance per cluster (its highest grade); ideal lists are cut by rank inside the window.
    """
    gain = lambda g: F.when(g == 2, 3.0).when(g == 1, 1.0).otherwise(0.0)
    grade = F.coalesce(F.col("grade"), F.lit(0))
    r = runs.where(F.col("rank") <= depth).join(judgments.select("query_id", "ad_id", "grade"), ["query_id", "ad_id"], "left").withColumn("grade", grade)
    per = judgments.groupBy("query_id", "cluster").agg(F.max(grade).alias("grade"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "cluster")
    top = per.withColumn("i", F.row_number().over(w)).where(F.col("i") <= depth).groupBy("query_id").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("i") + 1)).alias("ideal"))
    rel = per.groupBy("query_id").agg(F.count_if(F.col("grade") == 2).alias("n_rel"))
    s = r.groupBy("query_id", "method").agg(
        (F.count_if(F.col("grade") == 2) / depth).alias("p10"), (F.count_if(F.col("grade") >= 1) / depth).alias("p10_lenient"),
        F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1)).alias("dcg"), F.count_if(F.col("grade") == 2).alias("hits"),
    )
    s = s.join(top, "query_id", "left").join(rel, "query_id", "left")
    ndcg = F.when(F.coalesce("ideal", F.lit(0.0)) > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    recall = F.when(F.coalesce("n_rel", F.lit(0)) > 0, F.col("hits") / F.col("n_rel"))
    return s.select("query_id", "method", "p10", "p10_lenient", ndcg.alias("ndcg10"), recall.alias("recall"))


def summary(per_query: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c).cast("decimal(20,10)"), 3).cast("double").alias(c)
    return per_query.groupBy("method").agg(mean("p10"), mean("p10_lenient"), mean("ndcg10"), mean("recall"))


def stratified(docs: DataFrame, stratum: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """A sample of about n rows, strata in proportion to the root of their size, at least one each, by hash order.

    Hash order makes the sample repeatable; the allocation is computed over a table of strata.
    """
    sizes = docs.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum(F.sqrt("size")).alias("total"))  # one row
    share = F.greatest(F.round((F.lit(float(n)) * F.sqrt("size") / F.col("total")).cast("decimal(20,10)")), F.lit(1)).cast("int")
    alloc = sizes.join(F.broadcast(total)).select(stratum, share.alias("take"))
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed)))
    w = Window.partitionBy(stratum).orderBy(h, key)
    return docs.withColumn("_r", F.row_number().over(w)).join(alloc, stratum).where(F.col("_r") <= F.col("take")).drop("_r", "take")


def paired_bootstrap(per_query: DataFrame, metric: str, a: str, b: str, resamples: int = 2000, seed: int = 0, most: int = 1_000_000) -> DataFrame:
    """One row: mean difference a - b over questions and its 95 % interval from seeded resampling of the paired differences."""
    spark = per_query.sparkSession
    p = per_query.where(F.col("method").isin(a, b)).groupBy("query_id").agg(F.max(F.when(F.col("method") == a, F.col(metric))).alias("x"), F.max(F.when(F.col("method") == b, F.col(metric))).alias("y"))
    rows = p.where("x is not null and y is not null").select("query_id", (F.col("x") - F.col("y")).alias("d")).orderBy("query_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many questions for a bootstrap on the driver")
    d = np.array([r["d"] for r in rows], float)
    if not len(d):
        return spark.createDataFrame([], "n long, mean double, low double, high double")
    rng = np.random.default_rng(seed)
    means = np.array([d[rng.integers(0, len(d), len(d))].mean() for _ in range(resamples)])
    return spark.createDataFrame(pd.DataFrame({"n": [len(d)], "mean": [d.mean()], "low": [np.quantile(means, 0.025)], "high": [np.quantile(means, 0.975)]}))
