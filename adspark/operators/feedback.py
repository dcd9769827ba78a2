"""Answer logs: ratings joined to answers, citations checked, what an answer rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.functions.text import citations


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """The last rating of every (answer, user), by time; ties by the larger record."""
    rest = [c for c in ratings.columns if c not in ("answer_id", "user", "time")]
    g = ratings.groupBy("answer_id", "user").agg(F.max(F.struct("time", *rest)).alias("x"))
    return g.select("answer_id", F.col("user").alias("rated_by"), F.col("x.time").alias("rated_at"), *[f"x.{c}" for c in rest])


def interactions(answers: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row per answer and rater; answers nobody rated stay."""
    return answers.join(latest_ratings(ratings), "answer_id", "left")


def unknown_citations(answer: Column, seen: Column) -> Column:
    """Identifiers cited in an answer that none of its tool results holds."""
    return F.array_except(citations(answer), F.coalesce(seen, F.array().cast("array<string>")))


def basis(traces: DataFrame) -> DataFrame:
    """Per answer the distinct ads its tool results named, and how many calls it took. `trace` is an array of (tool, result)."""
    t = traces.select("answer_id", F.explode_outer("trace").alias("t")).select("answer_id", "t.tool", citations(F.col("t.result")).alias("ids"))
    calls = t.groupBy("answer_id").agg(F.count("tool").alias("calls"))
    seen = t.select("answer_id", F.explode("ids").alias("id")).groupBy("answer_id").agg(F.countDistinct("id").alias("ads_seen"))
    return calls.join(seen, "answer_id", "left").fillna(0, ["ads_seen"])
