"""Frequency of every distinct term, with marks for the too rare and the too common (problem 1).

Steps, none of which brings an unbounded set into one task or to the driver:

1. tokenize every record once per term it holds, weighted by the record's count;
2. pre-aggregate within blocks (one block per scan partition), so that a term that a third of all records hold shrinks to
   one row per block before anything is shuffled by term;
3. build the global integer dictionary: terms are hashed to buckets of about `per_bucket` terms, numbered inside their bucket,
   and the buckets' sizes give each bucket its offset, so identifiers are dense and repeatable;
4. encode the blocks' terms and lay them out as arrays of `width` consecutive identifiers: one count array for occurrences
   and one for record presence for each (block, identifier range);
5. add the arrays up by identifier range, position by position, and decode through the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.unicode import nfc
from adspark.runtime import cut

LETTERS = r"\p{L}+"


def record_terms(text: Column) -> Column:
    """The distinct terms of a record: runs of letters after NFC, lower-casing and long s as s; [] for NULL."""
    plain = F.translate(F.lower(nfc(text)), "ſ", "s")
    return F.coalesce(F.array_distinct(F.regexp_extract_all(plain, F.lit(LETTERS), F.lit(0))), F.array())


def dictionary(terms: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """(field, term) -> term_no: dense identifiers from 0, the same for the same set of terms. One shuffle by bucket.

    The number of buckets follows the number of terms, so numbering has as many tasks as the vocabulary needs.
    """
    distinct = cut(terms.select("field", "term").distinct())
    buckets = max(1, -(-distinct.count() // per_bucket))
    distinct = distinct.withColumn("_b", F.pmod(F.xxhash64("field", "term"), F.lit(buckets)).cast("int"))
    numbered = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("field", "term")) - 1)
    sizes = distinct.groupBy("_b").agg(F.count("*").alias("_n"))
    # One row per `per_bucket` terms: the window over all of them is short, and Spark broadcasts them only if they measure small.
    start = sizes.withColumn("_s", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).select("_b", "_s")
    return numbered.join(start, "_b").select("field", "term", (F.col("_s") + F.col("_r")).cast("long").alias("term_no"))


def _block_arrays(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            ranges, at = np.divmod(b["term_no"].to_numpy(np.int64), width)
            for r in np.unique(ranges):
                hit = ranges == r
                occ, rec = held.setdefault(int(r), [np.zeros(width, np.int64), np.zeros(width, np.int64)])
                np.add.at(occ, at[hit], b["occ"].to_numpy(np.int64)[hit])
                np.add.at(rec, at[hit], b["rec"].to_numpy(np.int64)[hit])
            if len(held) > 256:
                yield pd.DataFrame([(k, o.tolist(), c.tolist()) for k, (o, c) in held.items()], columns=["range_no", "occ", "rec"])
                held = {}
        if held:
            yield pd.DataFrame([(k, o.tolist(), c.tolist()) for k, (o, c) in held.items()], columns=["range_no", "occ", "rec"])

    return run


def term_frequencies(records: DataFrame, rare_below: int = 5, common_share: float = 0.02, width: int = 1024) -> DataFrame:
    """One row per (field, term): occurrences, records, share of the field's records, mark ('rare', 'common' or NULL).

    `records` has field string, text string, n long (weight of the record) and one row per record. NULL or empty texts
    hold no terms but count as records of their field; a NULL weight counts 0 occurrences and a negative one too; ties
    between marks go to 'common'. Very long texts are split whole. Extra columns are ignored; an empty table gives no rows.
    """
    base = records.select("field", F.coalesce("text", F.lit("")).alias("text"), F.greatest(F.coalesce(F.col("n").cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    totals = base.groupBy("field").agg(F.count("*").alias("field_records"))  # one row per field: a handful
    words = base.select("field", "n", record_terms(F.col("text")).alias("t")).select("field", "n", F.explode("t").alias("term"))
    block = words.withColumn("block", F.spark_partition_id())
    partial = cut(block.groupBy("block", "field", "term").agg(F.sum("n").alias("occ"), F.count("*").alias("rec")))
    terms = cut(dictionary(partial))
    coded = partial.join(terms, ["field", "term"]).select("block", "term_no", "occ", "rec")
    arrays = coded.repartition("block").mapInPandas(_block_arrays(width), "range_no long, occ array<long>, rec array<long>")
    # The sum by identifier range, position by position; Spark combines map-side, so a range never gathers all its arrays.
    flat = arrays.select("range_no", F.posexplode(F.arrays_zip("occ", "rec")).alias("at", "v")).where("v.rec > 0")
    summed = flat.groupBy((F.col("range_no") * width + F.col("at")).alias("term_no")).agg(F.sum("v.occ").alias("occurrences"), F.sum("v.rec").alias("records"))
    out = summed.join(terms, "term_no").join(F.broadcast(totals), "field")
    share = F.col("records") / F.col("field_records")
    mark = F.when(F.col("records") >= F.lit(common_share) * F.col("field_records"), "common").when(F.col("occurrences") < rare_below, "rare")
    return out.select("field", "term", "occurrences", "records", share.alias("share"), mark.alias("mark"))


def dictionary_records(position_dict: DataFrame, requirement_dict: DataFrame) -> DataFrame:
    """The two dictionaries as records: a missing count is n_spans + n_headings for positions and 1 for requirements."""
    p = position_dict.dropDuplicates(["form_id"]).select(
        F.lit("position").alias("field"), F.col("surface").alias("text"),
        F.coalesce(F.col("count").cast("long"), F.coalesce("n_spans", F.lit(0)) + F.coalesce("n_headings", F.lit(0))).alias("n"),
    )
    r = requirement_dict.dropDuplicates(["req_id"]).select(F.lit("requirement").alias("field"), F.col("surface").alias("text"), F.coalesce(F.col("count").cast("long"), F.lit(1)).alias("n"))
    return p.unionByName(r)
