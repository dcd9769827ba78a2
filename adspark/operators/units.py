"""Amounts recorded in different currencies and scales, converted to one unit (problem 7).

Every amount gets the unit in which it was written down. The evidence is, in this order, the sum and unit that the phrase
states, the currency column, and, where both are silent, a mixture over log-scale values.

The model is one mixture over log amounts. Its components are the known units; the offset of a component is the logarithm
of that unit's worth, so only weights, means and widths are fitted:

* a stated sum of worth V leaves log(amount) = log V - log worth(unit) + noise: components sit at known, narrow places, and
  the posterior names the unit whose offset explains the recorded amount ("42 Groschen" recorded as 0.42 is in Schilling,
  "1.690 fl." recorded as 1.69 in thousands of Gulden);
* without any named unit, log worth is normal by period of payment, the weights are the unit frequencies of the year and its
  neighbours, and what the standard column says counts as often as it says so beside that unit elsewhere; weights are refitted
  by expectation-maximisation on the rows that lack a unit, over a histogram.

Posteriors under `sure` are flagged `uncertain`. Rows without an amount keep NULLs; a phrase without a number falls back to
the mixture with the named unit as the only family.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspark.runtime import bounded_rows, cut

# Unit names and spellings in phrases and currency columns, main units before their parts.
UNIT_WORDS = [
    ("Reichspfennig", "reichspfennig|reichspfennige|rpf|rpfg"),
    ("Reichsmark", "reichsmark|rm|r.m"),
    ("Silbergroschen", "silbergroschen|sgr|sgl|ngr"),
    ("Thaler", "thaler|thlr|taler|tlr|rthlr|th"),
    ("Gulden", "gulden|fl|flor|florin|florins|guld"),
    ("Krone", "kronen|krone|k"),
    ("Kreuzer", "kreuzer|kr|xr|kreutzer"),
    ("Schilling", "schilling|schillinge|s|sch|schill"),
    ("Franc", "francs|franc|franken|frank|fr|frcs|frs|fres"),
    ("Mark", "mark|mk|m"),
    ("Heller", "heller|h|hl"),
    ("Groschen", "groschen|g|gr"),
    ("Pfennig", "pfennig|pfennige|pf|pfg"),
    ("Centime", "centimes|centime|cts|cent|c"),
]
CM_STATED = r"\bc\.? ?m(?:\.|\b)|\bconv(?:ention)?s?\b\.?[ -]*(?:m|münze|geld)"
OEW_STATED = r"\b(?:ö|oe|öst|oest|österr|oesterr|österreichischer?)\.? ?w(?:\.|\b|ähr|aehr)"
# German number words that stand for round sums.
ONES = {"ein": 1, "eine": 1, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "elf": 11, "zwölf": 12}
TENS = {"zwanzig": 20, "dreißig": 30, "dreissig": 30, "vierzig": 40, "fünfzig": 50, "sechzig": 60, "siebzig": 70, "achtzig": 80, "neunzig": 90}
SWITCH = "1858-11-01"  # the day on which the Gulden changed from convention money to Austrian currency

KINDS = [name for name, _ in UNIT_WORDS]
PAIRS = {"Gulden": "Kreuzer", "Krone": "Heller", "Mark": "Pfennig", "Franc": "Centime", "Thaler": "Silbergroschen", "Schilling": "Groschen", "Reichsmark": "Reichspfennig"}


def number_words() -> dict[str, float]:
    """Number words to values: ones, tens, hundreds and thousands, with or without a leading count."""
    out: dict[str, float] = {**{k: float(v) for k, v in ONES.items() if v > 1}, **{k: float(v) for k, v in TENS.items()}}
    for one, n in ONES.items():
        for ten, t in TENS.items():
            if n < 10:
                out[f"{one}und{ten}"] = float(n + t)
    small = dict(out)
    for base, word in ((100, "hundert"), (1000, "tausend")):
        out[word] = float(base)
        for one, n in ONES.items():
            out[f"{one}{word}"] = float(n * base)
            for rest, r in small.items():
                out[f"{one}{word}{rest}"] = float(n * base + r)
        for rest, r in small.items():
            out[f"{word}{rest}"] = float(base + r)
    return out


def _plain(text: Column) -> Column:
    """Lower case, long s as s, runs of blanks as one."""
    return F.regexp_replace(F.translate(F.lower(text), "ſ", "s"), r"\s+", " ")


def _bare(text: Column) -> Column:
    """The phrase without what it says about the standard, whose letters would read as units."""
    return F.regexp_replace(F.regexp_replace(_plain(text), "(?U)" + CM_STATED + r"\w*\.?", " "), "(?U)" + OEW_STATED + r"\w*\.?", " ")


def unit_kind(text: Column) -> Column:
    """Name of the unit that a phrase or a currency code names, the first in the order of UNIT_WORDS; else NULL."""
    rank = F.create_map(*[x for i, (_, words) in enumerate(UNIT_WORDS) for w in words.split("|") for x in (F.lit(w), F.lit(i))])
    tokens = F.regexp_extract_all(_bare(text), F.lit(r"\p{L}+(?:\.\p{L}+)*"), F.lit(0))
    first = F.array_min(F.transform(tokens, lambda w: F.try_element_at(rank, w)))
    return F.try_element_at(F.array(*[F.lit(k) for k in KINDS]), first + 1)


def stated_standard(text: Column) -> Column:
    t = _plain(text)
    return F.when(t.rlike("(?U)" + CM_STATED), "CM").when(t.rlike("(?U)" + OEW_STATED), "öW")


def stated_sum(text: Column, kind: Column) -> Column:
    """The sum a phrase states (the lower one of a range), in its main unit; a part after the main unit is added."""
    t = _plain(text)
    raw = F.regexp_extract(t, r"(\d{1,3}(?:[. ]\d{3})+(?!\d)|\d+)(?:,(\d+))?( ?½)?", 0)
    whole = F.regexp_replace(F.regexp_extract(raw, r"^(\d{1,3}(?:[. ]\d{3})+|\d+)", 1), "[. ]", "")
    part = F.regexp_extract(raw, r",(\d+)", 1)
    value = F.when(whole != "", F.concat(whole, F.lit("."), F.when(part != "", part).otherwise("0")).try_cast("double") + F.when(raw.contains("½"), 0.5).otherwise(0.0))
    minor = F.regexp_extract(t, r"\d[ .]*(?:fl|flor|gulden|k|kronen|m|mk|mark|fr|francs|s|schilling|rm|reichsmark)\.? ?(?:u\.?|und)? ?(\d{1,2}) ?(?:kr|kreuzer|h|heller|pf|pfennig|cts|centimes|g|groschen|rpf)\b", 1)
    of = F.when((kind == "Gulden") & (F.coalesce(stated_standard(text), F.lit("")) == "CM"), 60.0).when(kind == "Thaler", 30.0).otherwise(100.0)
    return value + F.when(minor != "", minor.try_cast("double") / of).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def spelled_sum(text: pd.Series) -> pd.Series:
    """The first number word of a phrase as a value; NULL where there is none."""
    words = number_words()
    return text.map(lambda s: next((words[w] for w in s.lower().replace("ſ", "s").split() if w in words), None) if isinstance(s, str) else None).astype("float64")


def ad_date(ad_id: Column) -> Column:
    """The date inside an ad_id (newspaper_yyyymmdd_page_region), NULL where it has none."""
    return F.try_to_timestamp(F.regexp_extract(ad_id, r"_(\d{8})_", 1), F.lit("yyyyMMdd")).cast("date")


def parse(salary: DataFrame) -> DataFrame:
    """Adds stated_unit, stated_std, stated_sum, ad_day: what phrase, currency and date say, JVM-side but for number words."""
    from_phrase = unit_kind(F.col("phrase"))
    kind = F.coalesce(from_phrase, unit_kind(F.col("currency")))
    day = F.coalesce(ad_date(F.col("ad_id")), F.make_date(F.col("year").cast("int"), F.lit(7), F.lit(1)))
    std = F.coalesce(stated_standard(F.col("phrase")), F.when(day < F.lit(SWITCH).cast("date"), "CM").when(day.isNotNull(), "öW"))
    df = salary.withColumn("stated_unit", kind).withColumn("unit_source", F.when(from_phrase.isNotNull(), "phrase").when(kind.isNotNull(), "currency"))
    df = df.withColumn("ad_day", day).withColumn("stated_std", F.when(F.col("stated_unit").isin("Gulden", "Kreuzer"), std))
    df = df.withColumn("date_std", F.when(day < F.lit(SWITCH).cast("date"), "CM").otherwise("öW"))
    digits = stated_sum(F.col("phrase"), F.col("stated_unit"))
    return df.withColumn("stated_sum", digits)


BINS = 10  # per natural logarithm
NEAR = 1.0  # years over which the unit frequencies of neighbouring years fade by e
RARE_PERIOD = 0.005  # periods of payment named in a smaller part of the rows share one normal


def _units_of(pay_units: DataFrame) -> pd.DataFrame:
    rows = bounded_rows(pay_units.select("unit_id", "unit_name", "standard", "kronen"), 10_000, "pay_units")
    return pd.DataFrame([r.asDict() for r in rows], columns=["unit_id", "unit_name", "standard", "kronen"])


def _told_standard(c: Column) -> Column:
    """What a standard column says, '' where it says nothing known."""
    t = F.concat(F.lit("0 "), _plain(F.coalesce(c, F.lit(""))))
    return F.coalesce(stated_standard(t), F.when(t.rlike(r"\bcm\b|conv"), "CM").when(t.rlike(r"ö\.? ?w|o\.?e\.? ?w"), "öW"), F.lit(""))


def fit(parsed: DataFrame, units: pd.DataFrame, rounds: int = 30) -> dict:
    """Fit the mixture on a histogram of all rows: log worth by period and standards by unit from rows with a unit, weights by year.

    The histogram is one row per (period, year, unit, standard, bin); it stays in Spark. What reaches the driver are its sums by
    period, by (year, unit, standard), and by (period, year, standard, bin) of the rows without a unit.
    """
    worth = {(u.unit_name, u.standard or ""): u.kronen for u in units.itertuples()}
    key = F.concat_ws("|", F.col("stated_unit"), F.coalesce(F.col("stated_std"), F.lit("")))
    kron = F.create_map(*[x for (n, s), k in worth.items() for x in (F.lit(f"{n}|{s}"), F.lit(float(k)))]) if worth else F.lit(None)
    rows = parsed.where(F.col("amount_min") > 0).select(
        F.coalesce("period", F.lit("")).alias("period"),
        F.coalesce(F.year("ad_day"), F.lit(0)).alias("year"),
        F.when(F.col("stated_unit").isNotNull(), key).alias("unit"),
        F.col("told_std").alias("std"),
        F.when(F.col("stated_unit").isNull(), F.floor(F.log("amount_min") * BINS)).otherwise(F.floor(F.log(F.coalesce("stated_sum", "amount_min") * F.try_element_at(kron, key)) * BINS)).cast("int").alias("bin"),
    )
    cells = cut(rows.groupBy("period", "year", "unit", "std", "bin").agg(F.count("*").alias("n")))
    most = cells.agg(F.sum("n")).first()[0] or 0
    often = [r["period"] for r in cells.groupBy("period").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE_PERIOD * most).collect()]  # 1 / RARE_PERIOD rows
    cells = cells.withColumn("period", F.when(F.col("period").isin(often), F.col("period")).otherwise(""))
    known, bound = cells.where("unit is not null"), 2_000_000
    x = F.col("bin") / BINS
    moments = known.where("bin is not null").groupBy("period").agg(F.sum("n").alias("n"), F.sum(x * F.col("n")).alias("s"), F.sum(x * x * F.col("n")).alias("q")).collect()
    named = bounded_rows(known.groupBy("year", "unit", "std").agg(F.sum("n").alias("n")), bound, "the units of years")
    open_ = bounded_rows(cells.where("unit is null and bin is not null").groupBy("period", "year", "std", "bin").agg(F.sum("n").alias("n")), bound, "the amounts without a unit")

    def normal(n: float, s: float, q: float) -> tuple[float, float]:
        m = s / max(n, 1)
        return m, math.sqrt(max(q / max(n, 1) - m * m, 0.25))

    norms: dict = {r["period"]: normal(r["n"], r["s"], r["q"]) for r in moments if r["n"] >= 30}
    norms[None] = normal(*[sum(r[c] for r in moments) for c in ("n", "s", "q")])
    names = {f"{u.unit_name}|{u.standard or ''}": i for i, u in enumerate(units.itertuples())}
    logw = np.log(np.maximum(units.kronen.to_numpy(float), 1e-12))
    overall = np.full(len(names), 0.01)
    told = {s: np.full(len(names), 0.5) for s in ("", "CM", "öW")}
    by_year: dict[int, np.ndarray] = {}
    for r in named:
        i = names.get(r["unit"])
        if i is not None:
            overall[i] += r["n"]
            told[r["std"]][i] += r["n"]
            by_year.setdefault(r["year"], np.zeros(len(names)))[i] += r["n"]
    overall = overall / (overall.sum() or 1)
    total = sum(told.values())
    told = {s: v / total for s, v in told.items()}
    lacking: dict[int, list] = {}
    for r in open_:
        lacking.setdefault(r["year"], []).append(r)
    weights = {}
    for y in sorted(by_year.keys() | lacking.keys()):
        prior = overall + sum(v * math.exp(-abs(y - z) / NEAR) for z, v in by_year.items() if abs(y - z) <= 8 * NEAR)
        w = prior / prior.sum()
        own = lacking.get(y, ())
        if own:
            n = np.array([r["n"] for r in own], float)
            mean, sd = np.array([norms.get(r["period"], norms[None]) for r in own]).T[:, :, None]
            like = -((np.array([r["bin"] for r in own])[:, None] / BINS + logw - mean) ** 2) / (2 * sd * sd) + np.log(np.array([told[r["std"]] for r in own]))
            for _ in range(rounds):
                q = np.log(w + 1e-12) + like
                q = np.exp(q - q.max(1, keepdims=True))
                new = prior + (q / q.sum(1, keepdims=True) * n[:, None]).sum(0)
                new /= new.sum()
                moved, w = np.abs(new - w).max(), new
                if moved < 1e-6:
                    break
        weights[int(y)] = w.tolist()
    return {"norms": norms, "weights": weights, "overall": overall.tolist(), "told": {s: v.tolist() for s, v in told.items()}}


RESULT = T.StructType([
    T.StructField("unit_id", T.LongType()), T.StructField("posterior", T.DoubleType()), T.StructField("uncertain", T.BooleanType()),
    T.StructField("kronen_min", T.DoubleType()), T.StructField("kronen_max", T.DoubleType()),
])


def convert(salary: DataFrame, pay_units: DataFrame, sure: float = 0.9, noise: float = 0.004) -> DataFrame:
    """One row per (ad_id, span_start): the row's columns, the unit of its amount, the posterior and both amounts in Kronen.

    Null amounts get null results; zero and negative amounts too, as they have no logarithm. Rows delivered twice count
    once. Extra columns are kept, but for those named like the result's, which are replaced. An empty table gives an empty
    result with the full schema. No two units tie: equal posteriors go to the unit named, then the smaller unit_id.
    """
    names = [f.name for f in RESULT] + ["stated_unit", "unit_source", "ad_day", "stated_std", "date_std", "stated_sum", "told_std"]
    salary = salary.drop(*[c for c in names if c in salary.columns]).dropDuplicates(["ad_id", "span_start"])
    units = _units_of(pay_units)
    parsed = parse(salary)
    spelled = F.when(F.col("stated_sum").isNull() & F.col("phrase").rlike(r"\p{L}{4}"), spelled_sum(F.col("phrase")))
    parsed = parsed.withColumn("stated_sum", F.coalesce("stated_sum", spelled))
    parsed = parsed.withColumn("told_std", _told_standard(F.col("standard")) if "standard" in salary.columns else F.lit(""))
    model = fit(parsed, units)
    return _posterior(parsed, units, model, sure, noise)


def _posterior(parsed: DataFrame, units: pd.DataFrame, model: dict, sure: float, noise: float) -> DataFrame:
    ids = units.unit_id.to_numpy(np.int64)
    kron = units.kronen.to_numpy(float)
    logw = np.log(np.maximum(kron, 1e-12))
    base = [u.removeprefix("tausend ").removesuffix("n") if u.startswith("tausend K") else u.removeprefix("tausend ") for u in units.unit_name]
    major = {v: k for k, v in PAIRS.items()}
    family = np.array([major.get(b, b) for b in base], object)
    standard = np.array([s or "" for s in units.standard], object)
    named = {(n, s or ""): i for i, (n, s) in enumerate(zip(units.unit_name, units.standard, strict=True))}
    overall = np.array(model["overall"])
    weights = {y: np.array(w) for y, w in model["weights"].items()}
    standards = {s: np.array(w) for s, w in model["told"].items()}

    @F.pandas_udf(RESULT)
    def assign(amount: pd.Series, high: pd.Series, total: pd.Series, kind: pd.Series, std: pd.Series, date_std: pd.Series, told: pd.Series, year: pd.Series, period: pd.Series) -> pd.DataFrame:
        out = {"unit_id": [], "posterior": [], "uncertain": [], "kronen_min": [], "kronen_max": []}
        for a, b, v, k, s, ds, ts, y, p in zip(amount, high, total, kind, std, date_std, told, year, period, strict=True):
            if a is None or not a > 0 or not len(ids):
                for x in out.values():
                    x.append(None)
                continue
            s, k = s if isinstance(s, str) else None, k if isinstance(k, str) else None
            at = named.get((k, s or "")) if k else None
            if at is None and k:
                at = named.get((k, ""))
            fits = (standard == "") | (standard == (s or ds or "öW"))
            w = weights.get(int(y), overall) * fits
            if at is None:
                w = w * standards[ts]
            if at is not None:
                near = fits & (family == family[at])
                w = np.where(near, 0.1, 0.0) if v == v and v else np.where(near, overall + 1e-6, 0.0)
                w[at] = w[at] * 3 + 0.1
            if at is not None and v == v and v and v > 0:
                z = (math.log(a) - (math.log(v) + logw[at] - logw)) / noise
                # A wide second component keeps the posterior honest where no unit explains the ratio of sum and amount.
                like = np.exp(-np.minimum(z * z / 2, 700)) + 1e-9 * np.exp(-np.abs(z) * noise)
            else:
                m, sd = model["norms"].get(p if isinstance(p, str) else "", model["norms"][None])
                like = np.exp(-((math.log(a) + logw - m) ** 2) / (2 * sd * sd))
            q = w * like
            q = q / q.sum() if q.sum() > 0 else w / max(w.sum(), 1e-300)
            i = int(np.argmax(q))
            far = at is not None and v == v and v and v > 0 and abs(math.log(a) - (math.log(v) + logw[at] - logw[i])) > 0.02
            out["unit_id"].append(int(ids[i]))
            out["posterior"].append(float(q[i]))
            out["uncertain"].append(bool(q[i] < sure or far))
            out["kronen_min"].append(float(a * kron[i]))
            out["kronen_max"].append(float(b * kron[i]) if b == b and b is not None else None)
        frame = pd.DataFrame(out)
        return frame.astype({"unit_id": "Int64"})

    year = F.coalesce(F.year("ad_day"), F.lit(0))
    cols = [F.col(c).cast("double") for c in ("amount_min", "amount_max", "stated_sum")]
    df = parsed.withColumn("_u", assign(*cols, F.col("stated_unit"), F.col("stated_std"), F.col("date_std"), F.col("told_std"), year, F.col("period")))
    return df.select("*", "_u.*").drop("_u", "date_std", "told_std")
