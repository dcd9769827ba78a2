"""Log tables kept up incrementally: every arrival once, whatever is lost on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(spark: SparkSession, source: str, schema: str, target: str, state: str, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> None:
    """Process the JSON files that arrived in `source` since the last call, then stop.

    A batch that is repeated after a failure adds nothing: rows whose keys the target holds are left out. `state` is a folder
    that all executors share.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = step(batch).dropDuplicates(keys)
        try:
            new = new.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        except Exception as e:  # noqa: BLE001 - the target does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per key and time window of a stream (or a table), dropping what comes later than the watermark allows."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    return e.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
