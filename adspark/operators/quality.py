"""Normalized text and quality measures of every ad."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.functions import text as T
from adspark.functions.unicode import nfc

# Thresholds of the flags.
REPEAT_LEAST, REPEAT_FACTOR, EXPANDED, LEAST_SUPPORT, SHORT = 4, 2, 1.3, 0.6, 30


def assess(ads: DataFrame) -> DataFrame:
    """One row per input row: normalized texts, language, measures and flags. A pure projection; no shuffle."""
    t, o = F.coalesce("_t", F.lit("")), F.coalesce("_o", F.lit(""))
    df = ads.select("ad_id", "newspaper", "year", "label", nfc(F.col("text")).alias("_t"), nfc(F.col("text_ocr")).alias("_o"), nfc(F.col("heading_text")).alias("_h"))
    df = df.withColumn("text_norm", T.normalize_text(t)).withColumn("heading_norm", F.nullif(T.normalize_text(F.col("_h")), F.lit("")))
    df = df.withColumns({
        "lang": T.guess_language(F.col("text_norm")), "sim_ocr": T.indel_ratio(t, o), "len_ratio": F.length(t) / F.greatest(F.length(o), F.lit(1)),
        "repeat_max": T.max_ngram_repeat(t), "repeat_max_ocr": T.max_ngram_repeat(o), "ocr_wordlike": T.wordlike_share(o),
        "ocr_support": T.ocr_support(t, o), "death_entries": T.death_register_entries(t),
    })
    flags = {
        "flag_pc_repetition": (F.col("repeat_max") >= REPEAT_LEAST) & (F.col("repeat_max") >= REPEAT_FACTOR * F.greatest("repeat_max_ocr", F.lit(1))),
        "flag_pc_expanded": F.col("len_ratio") > EXPANDED,
        "flag_pc_unsupported": F.col("ocr_support") < LEAST_SUPPORT,
        "flag_too_short": (F.length("text_norm") < SHORT) & ~F.col("label").eqNullSafe("heading"),
        "flag_death_register": F.col("death_entries") > 0,
    }
    df = df.withColumns(flags)
    n = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    return df.withColumn("n_flags", n.cast("byte")).drop("_t", "_o", "_h", "label")
