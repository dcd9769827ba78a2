"""Logs: incremental reading, ratings, citations, the basis of an answer."""

import json

from pyspark.sql import functions as F

from adspark.operators import feedback
from adspark.streaming.incremental import drain, windowed_counts

A, B = "wrz_18700408_013_region_0001", "wrz_18700408_013_region_0002"


def test_drain_takes_every_record_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def put(name, *records):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in records), encoding="utf-8")

    put("a.json", {"id": "1", "n": 1}, {"id": "1", "n": 1}, {"id": "2", "n": 2})
    drain(spark, src, "id string, n int", out, state, lambda d: d.withColumn("n", F.col("n") * 10), ["id"])
    put("b.json", {"id": "2", "n": 2}, {"id": "3", "n": 3})
    drain(spark, src, "id string, n int", out, state, lambda d: d.withColumn("n", F.col("n") * 10), ["id"])
    assert sorted((r.id, r.n) for r in spark.read.parquet(out).collect()) == [("1", 10), ("2", 20), ("3", 30)]


def test_windowed_counts(spark):
    e = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:06:00", "a")], "ts string, event_type string")
    assert sorted(r.n for r in windowed_counts(e).collect()) == [1, 2]


def test_feedback(spark):
    ratings = spark.createDataFrame([("x", "u", 1, "bad"), ("x", "u", 2, "good"), ("x", "v", 1, "ok")], "answer_id string, user string, time int, verdict string")
    answers = spark.createDataFrame([("x", f"siehe {A} und {B}", [A]), ("y", None, None)], "answer_id string, answer string, seen array<string>")
    got = sorted((r.answer_id, r.rated_by or "", r.verdict or "") for r in feedback.interactions(answers, ratings).collect())
    assert got == [("x", "u", "good"), ("x", "v", "ok"), ("y", "", "")]
    un = {r.answer_id: r.u for r in answers.select("answer_id", feedback.unknown_citations(F.col("answer"), F.col("seen")).alias("u")).collect()}
    assert un == {"x": [B], "y": []}
    t = spark.createDataFrame([("x", [("search", A + " " + B), ("get", A)]), ("y", None)], "answer_id string, trace array<struct<tool:string,result:string>>")
    assert {r.answer_id: (r.calls, r.ads_seen) for r in feedback.basis(t).collect()} == {"x": (2, 2), "y": (0, 0)}
