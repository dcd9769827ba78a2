"""Repetition inside a single document, measured and judged by weak supervision (problem 4).

Every document is measured once, in one Arrow pass without a shuffle: the share of its words inside runs of four words that
began earlier in it, the share of repeated sentences and lines, and how much its words outnumber its distinct ones. Rules
over these measures, and the flag that came with the data, vote 'repeated', 'clean' or abstain. Expectation-maximisation
over the counts of vote patterns (at most 3^rules rows, whatever the number of documents) estimates how often each rule is
right, and a document gets the posterior probability of its pattern. No rule alone decides, and none can veto.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.runtime import bounded_rows, cut, spread

WORD = regex.compile(r"[\p{L}\p{N}]+")
SENTENCE_END = regex.compile(r"[.!?]\s+|\n")
RUN = 4  # words in a run
LEAST_WORDS = 8


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case, with long s as s."""
    return WORD.findall(text.lower().replace("ſ", "s"))


def run_share(w: list[str], run: int = RUN) -> float:
    """Share of the words inside a run of `run` words that already began earlier; 0 below LEAST_WORDS words."""
    n = len(w)
    if n < LEAST_WORDS:
        return 0.0
    grams = list(zip(*[w[i:] for i in range(run)], strict=False))
    if len(set(grams)) == len(grams):
        return 0.0
    seen: set = set()
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if g in seen:
            covered += i + run - max(i, end)
            end = i + run
        else:
            seen.add(g)
    return covered / n


def sentence_share(text: str) -> float:
    """Share of the characters in sentences or lines that occurred before."""
    parts = [p.strip().lower().replace("ſ", "s").rstrip(".!?") for p in SENTENCE_END.split(text)]
    parts = [p for p in parts if len(p) > 3]
    if len(set(parts)) == len(parts):
        return 0.0
    seen: set = set()
    again = 0
    for p in parts:
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / max(1, sum(map(len, parts)))


def measure(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, run_share, sentence_share, excess): one Arrow pass, no shuffle. NULL texts measure 0 words."""
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, share, sent, excess = [], [], [], []
            for t in b.column("t").to_pylist():
                w = words_of(t) if t else []
                s = run_share(w)
                n.append(len(w))
                share.append(s)
                sent.append(sentence_share(t) if t else 0.0)
                excess.append(1 - len(set(w)) / len(w) if w else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n, pa.int32()), pa.array(share, pa.float64()), pa.array(sent, pa.float64()), pa.array(excess, pa.float64())], names=["k", "n_words", "run_share", "sentence_share", "excess"])

    return spread(src).mapInArrow(run, f"k {kind}, n_words int, run_share double, sentence_share double, excess double").withColumnRenamed("k", key)


# The rules. Each votes 'repeated' above its upper bound, 'clean' below its lower one and abstains between.
RULES = {"run_share": (0.10, 0.30), "sentence_share": (0.05, 0.25), "excess": (0.35, 0.55)}


def votes(measured: DataFrame) -> DataFrame:
    """Adds the array `votes` (1 repeated, 0 clean, -1 abstain), one vote per rule and one of the flag; short texts abstain."""
    short = F.col("n_words") < LEAST_WORDS
    v = [F.when(short, -1).when(F.col(m) >= hi, 1).when(F.col(m) < lo, 0).otherwise(-1) for m, (lo, hi) in RULES.items()]
    v.append(F.when(F.col("flag"), 1).when(~F.col("flag"), 0).otherwise(-1))
    return measured.withColumn("votes", F.array(*[x.cast("int") for x in v]))


def fit_votes(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 100) -> tuple[float, np.ndarray]:
    """EM for one hidden class and independent voters: the prior and an array [rule, class, vote] of vote probabilities."""
    if not patterns:
        return 0.5, np.zeros((0, 2, 3))
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    # Start from the majority of the votes that were cast, so that class 1 means 'repeated'.
    cast = (v >= 0).sum(1)
    q = np.where(cast > 0, (v == 1).sum(1) / np.maximum(cast, 1), 0.1)
    q = np.clip(q, 0.02, 0.98)
    for _ in range(rounds):
        prior = float(np.clip((q * n).sum() / n.sum(), 1e-6, 1 - 1e-6))
        table = np.zeros((v.shape[1], 2, 3))
        for j, c in itertools.product(range(v.shape[1]), (0, 1)):
            w = n * (q if c else 1 - q)
            table[j, c] = [w[v[:, j] == x].sum() + 0.5 for x in (-1, 0, 1)]
            table[j, c] /= table[j, c].sum()
        new = posterior(v, prior, table)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return prior, table


def posterior(v: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability of 'repeated' for each row of votes."""
    lp = np.full((len(v), 2), [np.log1p(-prior), np.log(prior)])
    for j in range(v.shape[1]):
        lp += np.log(table[j][:, v[:, j] + 1]).T
    lp -= lp.max(1, keepdims=True)
    e = np.exp(lp)
    return e[:, 1] / e.sum(1)


def repetition(docs: DataFrame, key: str = "ad_id", text: str = "text", flags: DataFrame | None = None) -> DataFrame:
    """One row per document: its measures, votes and the probability that its content repeats itself.

    `flags` has the key and a boolean column `flag`, a judgement that came with the data; only the measures, not the texts,
    are shuffled to meet it. Documents without a flag, or with a NULL one, get no vote of it.

    Documents delivered twice count once (the largest values of equal keys hold, so that repeats that differ give a defined
    row). NULL and empty texts have no words, abstain everywhere and get the prior's posterior. Very long texts are
    measured whole. Extra columns are ignored. An empty table gives no rows.
    """
    m = measure(docs, key, text)
    m = m.groupBy(key).agg(*[F.max(c).alias(c) for c in m.columns if c != key])
    if flags is None:
        m = m.withColumn("flag", F.lit(None).cast("boolean"))
    else:
        m = m.join(flags.groupBy(key).agg(F.max(F.col("flag").cast("boolean")).alias("flag")), key, "left")
    m = cut(m)
    v = votes(m)
    seen = bounded_rows(v.groupBy("votes").agg(F.count("*").alias("n")), 3 ** (len(RULES) + 1), "the vote patterns")
    patterns = sorted((tuple(r["votes"]), float(r["n"])) for r in seen)
    prior, table = fit_votes(patterns)
    q = posterior(np.array([p for p, _ in patterns]), prior, table) if patterns else []
    name = F.concat_ws(",", F.col("votes").cast("array<string>"))
    lookup = F.create_map(*[x for (p, _), x_ in zip(patterns, q, strict=True) for x in (F.lit(",".join(map(str, p))), F.lit(float(x_)))]) if patterns else F.create_map(F.lit(""), F.lit(0.0))
    return v.withColumn("probability", F.try_element_at(lookup, name))


def found(docs: DataFrame, key: str = "ad_id", text: str = "text", flags: DataFrame | None = None, share: float = 0.3, least: float = 0.5) -> DataFrame:
    """Documents that the rules, weighed by their estimated accuracy, hold for repeated, checked exactly by the measured run share."""
    r = repetition(docs, key, text, flags)
    return r.where((F.col("probability") >= least) & (F.col("run_share") >= share) & F.col(key).isNotNull()).select(key)
