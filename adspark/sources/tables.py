"""Reading and writing: extraction CSVs, the catalog, partitioned tables, JSON logs."""

from __future__ import annotations

import ast
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "array<struct<start:int,end:int,text:string>>"
SPAN_COLUMNS = {
    "salary": "salary", "salary_importance": "salary_importance", "salary_period": "salary_period", "unspecific_salary": "unspecific_salary",
    "verpflegung": "verpflegung", "activity": "activity", "attitude towards work": "attitude_towards_work", "background": "background",
    "interpersonal": "interpersonal", "job specific": "job_specific", "language": "language",
}
METADATA = r"^([a-z]+)_(\d{8})_(\d{3})"
CSV = T.StructType([T.StructField(c, T.StringType()) for c in ("source_row", "metadata", "region_id", "reading_order", "text", "post_corrected", "min_x", "max_x", "min_y", "max_y", "prediction_label", "iiif_link", "position", "gender", *SPAN_COLUMNS)])
GAP, OVERLAP = 80, 0.5


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])))
def literal_spans(value: pd.Series) -> pd.Series:
    """A literal list of (start, end, text) as structs; blank or NULL is an empty list."""
    def one(v: object) -> list:
        return [{"start": int(s), "end": int(e), "text": t} for s, e, t in ast.literal_eval(v)] if isinstance(v, str) and v.strip() else []

    return value.map(one)


def aligned_positions(position: Column, gender: Column) -> Column:
    """Position spans with genders, which count only if they stand at the same places."""
    fits = (F.size(position) == F.size(gender)) & F.forall(F.arrays_zip(position.alias("p"), gender.alias("g")), lambda x: (x["p"]["start"] == x["g"]["start"]) & (x["p"]["end"] == x["g"]["end"]))
    none = F.lit(None).cast("string")
    both = F.zip_with(position, gender, lambda p, g: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"), g["text"].alias("gender")))
    alone = F.transform(position, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"), none.alias("gender")))
    return F.when(fits, both).otherwise(alone)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction CSVs as ads. A row whose metadata cannot be parsed stops the read; irregular duplicates are dropped.

    Of rows with equal ad_id, or equal link and text, the regular one stays, then the first.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(CSV).csv(path)
    raw = raw.withColumn("source_row", F.coalesce(F.col("source_row").try_cast("long"), F.monotonically_increasing_id()))
    ok = F.col("metadata").rlike(METADATA)
    raw = raw.withColumn("metadata", F.when(ok, F.col("metadata")).otherwise(F.raise_error(F.concat(F.lit("metadata cannot be parsed: "), F.coalesce("metadata", F.lit("NULL"))))))
    part = [F.regexp_extract("metadata", METADATA, i) for i in (1, 2, 3)]
    day = F.to_date(part[1], "yyyyMMdd")
    df = raw.select(
        F.concat_ws("_", *part, "region_id").alias("ad_id"), part[0].alias("newspaper"), day.alias("date"), F.year(day).cast("short").alias("year"),
        F.expr("cast(year(to_date(regexp_extract(metadata, '" + METADATA.replace("\\", "\\\\") + "', 2), 'yyyyMMdd')) div 10 * 10 as short)").alias("decade"), part[2].cast("short").alias("page"),
        "region_id", F.col("reading_order").cast("int").alias("reading_order"), F.col("prediction_label").alias("label"), F.col("post_corrected").alias("text"), F.col("text").alias("text_ocr"),
        *[F.col(c).cast("int").alias(c) for c in ("min_x", "max_x", "min_y", "max_y")], "iiif_link", literal_spans("position").alias("_p"), literal_spans("gender").alias("_g"),
        *[literal_spans(F.col(c)).alias(n) for c, n in SPAN_COLUMNS.items()], F.col("metadata").alias("metadata_raw"), "source_row",
    )
    df = df.withColumn("positions", aligned_positions(F.col("_p"), F.col("_g"))).drop("_p", "_g")
    odd = ~F.col("metadata_raw").rlike(METADATA + "$")
    order = [odd, F.col("source_row")]
    seen_id = F.row_number().over(Window.partitionBy("ad_id").orderBy(*order))
    seen_text = F.row_number().over(Window.partitionBy("iiif_link", "text").orderBy(*order))
    return df.withColumn("_i", seen_id).withColumn("_t", seen_text).where("_i = 1 and _t = 1").drop("_i", "_t")


def link_headings(ads: DataFrame) -> DataFrame:
    """Every heading attached to the ad directly below it in its column; of two headings the closer, then the earlier stays.

    The equi-part of the join is the page, so a task compares the regions of one page only.
    """
    h = ads.where("label = 'heading'").select("newspaper", "date", "page", F.col("ad_id").alias("h_id"), F.col("text").alias("h_text"), *[F.col(c).alias("h_" + c) for c in ("min_x", "max_x", "min_y", "max_y")])
    a = ads.where("label is null or label <> 'heading'").select("newspaper", "date", "page", "ad_id", "min_x", "max_x", "min_y")
    over = (F.least("max_x", "h_max_x") - F.greatest("min_x", "h_min_x")) / F.greatest(F.col("h_max_x") - F.col("h_min_x"), F.lit(1))
    gap = F.col("min_y") - F.col("h_max_y")
    c = h.join(a, ["newspaper", "date", "page"]).where((over >= OVERLAP) & (F.col("min_y") >= F.col("h_min_y")) & (gap <= GAP)).withColumn("gap", gap)
    near = c.withColumn("r", F.row_number().over(Window.partitionBy("h_id").orderBy("gap", "ad_id"))).where("r = 1")
    won = near.withColumn("r", F.row_number().over(Window.partitionBy("ad_id").orderBy("gap", "h_id"))).where("r = 1")
    link = won.select("ad_id", F.col("h_text").alias("heading_text"), F.col("h_id").alias("heading_ad_id"), F.col("gap").cast("int").alias("heading_gap_px"))
    return ads.drop("heading_text", "heading_ad_id", "heading_gap_px").join(link, "ad_id", "left")


class Catalog:
    """Temporary views over the Parquet tables of a folder; files with other columns are merged by name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def register(self, *names: str) -> Catalog:
        for n in names:
            self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{n}").createOrReplaceTempView(n.removesuffix(".parquet"))
        return self

    def sql(self, query: str, args: dict | list | None = None) -> DataFrame:
        return self.spark.sql(query, args=args) if args else self.spark.sql(query)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, cast to its types; missing ones are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_partitioned(df: DataFrame, path: str, schema: T.StructType | None = None, by: tuple[str, ...] = ("newspaper", "year")) -> None:
    """Replace only the partitions present in df."""
    (conform(df, schema) if schema else df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_line(path: str, record: dict) -> None:
    """One record appended to a JSON log from the driver."""
    with Path(path).open("a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False) + "\n")


def request_key(*columns: str) -> Column:
    """Cache key of a request: SHA-256 of its JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "request_key") -> DataFrame:
    return requests.join(cache.select(key), key, "left_anti")
