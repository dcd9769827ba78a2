"""Keyword-stuffed pages and link lists (problem 10).

Two kinds of evidence meet. List density, measured on every page in one pass: link entries, tags, and stretches of words
without the function words that hold sentences together, or that say the same few words over and over. And replicated
phrases: the five-word shingles of all pages are exploded, the distinct hosts of each are counted, and every stretch gets the
share of its shingles that stand on several hosts.

Density decides most stretches; it leaves short ones without function words open. What replication says about those differs
between collections: where spam is stitched from copied phrases, lists are replicated; where it is shuffled from a stock of
keywords, hardly any of its five-word phrases comes again while stock sentences do. So the evidence is calibrated: on all
pages the replicated shares and the shares of words that come again are counted for stretches that density calls lists and
for those it calls text, and an open stretch takes the side whose likelihood is larger.

Price tables and numbered registers are no lists of keywords; their lines count as text.

Only 64-bit hashes are shuffled, reduced to one row per shingle in every task before hosts are counted (for more than two
hosts, per shingle and host), so a phrase that stands on a third of all pages is one row per task. Pages never are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.runtime import bounded_rows, cut, spread

# The function words of the five languages.
FUNCTION_WORDS = frozenset("""
der die das den dem des ein eine einen einem einer eines und oder in im ins mit auf zu zum zur von vom bei beim für nach aus an am als
sich wird werden wurde sind ist hat nicht daß dass so was wie um bis ohne gegen durch unter wenn sobald obwohl weil man wo es er sie
le la les l un une des du d de et ou à au aux en dans pour par sur avec sans qui que se sont est on ce bien dès son sa ses ont
lo gli i il del della dei delle dello degli al alla ai di da e o che per con su nel nella nell senza si sono è uno una tra come fino dal dalla
the a an of and or to for with without at by on as was is are from who whose will has have his her among their in that this
v ve na z ze s pro po bez mezi k ke u do za od jak když aby nebo podle při kde však je jsou před přes pod nad až toho ten ta to které který jako
""".split())  # fmt: skip
LINK = regex.compile(r"https?://|www\.|\]\(|\.html?\b|(?<=\s)/[\p{L}\d_-]{3,}$|^/[\p{L}\d_-]{3,}")
NUMBERED = regex.compile(r"^\s*(?:\d{1,5}|[ivxlcIVXLC]{1,6})[.)]\s+\S")
HYPHEN = regex.compile(r"(?<=\p{L})[-⸗¬=]\s*\n\s*(?=\p{Ll})")
END = regex.compile(r"(?<=[\p{L}\p{N}\"”)][.!?])\s+")
PUNCT = " \t.,;:!?\"'„“»«()[]|·•/>*–—-_#"
LEAST_SENTENCE = 4  # shorter pieces without function words decide nothing


SEEN: dict[str, tuple[str, bool]] = {}  # of every token its compared form and whether it is a function word; cleared when it grows large


def look(token: str) -> tuple[str, bool]:
    """A token in lower case without punctuation, and whether it is a function word or begins with one; '' without letter or figure."""
    got = SEEN.get(token)
    if got is None:
        if len(SEEN) > 500_000:
            SEEN.clear()
        w = token.lower().replace("ſ", "s").strip(PUNCT) if any(c.isalnum() for c in token) else ""
        got = SEEN[token] = w, w in FUNCTION_WORDS or any(q in w and w.split(q)[0] in FUNCTION_WORDS for q in "'’")
    return got


def stretches(text: str) -> Iterator[tuple[str, list[str]]]:
    """(kind, words) of the pieces of a page: 'link', 'table' (priced or numbered lines) or 'run' (sentence or list)."""
    for para in text.split("\n\n"):
        held: list[str] = []
        for line in HYPHEN.sub("", para).split("\n"):
            if not line.strip():
                continue
            words = [w for w in line.split() if look(w)[0]]
            if LINK.search(line):
                yield from _runs(held)
                held = []
                yield "link", words
            elif NUMBERED.match(line) or _priced(words):
                yield from _runs(held)
                held = []
                yield "table", words
            else:
                held.append(line)
        yield from _runs(held)


def _priced(words: list[str]) -> bool:
    """Lines a third of whose words are figures: price tables."""
    return len(words) >= 3 and 3 * sum(w.strip(PUNCT).replace(",", "").replace(".", "").isdigit() for w in words) >= len(words)


def _runs(lines: list[str]) -> Iterator[tuple[str, list[str]]]:
    if lines:
        for part in END.split(" ".join(lines)):
            words = [w for w in part.split() if look(w)[0]]
            if words:
                yield "run", words


def _plain(words: list[str]) -> list[str]:
    """Words as compared: lower case, without punctuation."""
    return [look(w)[0] for w in words]


def judge(words: list[str]) -> tuple[int, list[str]]:
    """The kind of a run (0 list, 1 open, 2 text) and its words as compared."""
    n = len(words)
    looks = [look(w) for w in words]
    plain = [w for w, _ in looks]
    if 2 * sum(w[0] == "#" for w in words) > n:
        return 0, plain
    glue = sum(g for _, g in looks)
    content = [w for w, _ in looks if len(w) >= 3 and w not in FUNCTION_WORDS]
    again = sum(c for c in Counter(content).values() if c >= 2)
    if n >= 12 and glue < 0.06 * n and (n >= 25 or again >= 0.2 * n):
        return 0, plain
    if n >= 6 and again >= 0.5 * n:
        return 0, plain
    if n >= LEAST_SENTENCE and glue < 0.06 * n:
        return 1, plain
    return 2, plain


KINDS = ("list", "open", "text")
SHINGLE = 5
WORD_BITS: dict[str, int] = {}


def shingles(plain: list[str], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct five-word runs of a page and the kind of stretch each lies in whole, -1 across borders.

    A run that occurs in several kinds counts for the first.
    """
    if len(plain) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    if len(WORD_BITS) > 500_000:
        WORD_BITS.clear()
    codes = np.empty(len(plain), np.uint64)
    for i, w in enumerate(plain):
        c = WORD_BITS.get(w)
        if c is None:
            c = WORD_BITS[w] = xxhash.xxh3_64_intdigest(w)
        codes[i] = c
    k = np.array(kinds, np.int8)
    n = len(plain) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    same = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            h = (h ^ codes[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            same &= k[j : n + j] == k[:n]
    distinct, first = np.unique(h.view(np.int64), return_index=True)
    return distinct, np.where(same, k[:n], np.int8(-1))[first]


def measure(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One Arrow pass: (key, host, n_words, words and share of words that come again of each kind, shingles, their kinds)."""
    src = docs.select(F.col(key).alias("k"), F.col(host).cast("string").alias("h"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    names = [f"{k}_{x}" for k in KINDS for x in ("words", "again")]
    types = [pa.int32(), pa.float64()] * len(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals: list[int] = []
            columns: list[list] = [[] for _ in names]
            hashes, kinds = [], []
            for t in b.column("t").to_pylist():
                n = [0, 0, 0]
                forms: list[Counter] = [Counter(), Counter(), Counter()]
                plain: list[str] = []
                of: list[int] = []
                for what, words in stretches(t or ""):
                    k, low = (0, _plain(words)) if what == "link" else (2, _plain(words)) if what == "table" else judge(words)
                    n[k] += len(words)
                    forms[k].update(low)
                    plain += low
                    of += [k] * len(low)
                totals.append(sum(n))
                for k in range(3):
                    columns[2 * k].append(n[k])
                    columns[2 * k + 1].append(sum(c for c in forms[k].values() if c > 1) / max(1, forms[k].total()))
                h, k = shingles(plain, of)
                hashes.append(h)
                kinds.append(k)
            arrays = [pa.array(totals, pa.int32()), *[pa.array(c, ty) for c, ty in zip(columns, types, strict=True)], pa.array(hashes, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), *arrays], names=["k", "host", "n_words", *names, "shingles", "kinds"])

    schema = f"k {kind}, host string, n_words int, " + ", ".join(f"{n} {'int' if n.endswith('words') else 'double'}" for n in names) + ", shingles array<bigint>, kinds array<tinyint>"
    return spread(src).mapInArrow(run, schema).withColumnRenamed("k", key)


BINS = 6


def _bin(share: Column) -> Column:
    """0 for none, then one bin for each fifth, and the last for all but a twentieth: copies of whole pages replicate everything."""
    return F.when(share > 0.95, BINS).when(share > 0, F.ceil(share * (BINS - 1))).otherwise(0).cast("int")


def calibrate(counts: list[tuple[int, int, int, float]]) -> dict[tuple[int, int], float]:
    """Logarithms of how much likelier lists are than text, by (bin of replicated share, bin of words that come again).

    `counts` are (kind 0 list or 2 text, bin, bin, words). The two shares are taken as independent within a kind.
    """
    table = {k: np.ones((2, BINS + 1)) for k in (0, 2)}
    for k, r, a, n in counts:
        table[k][0, r] += n
        table[k][1, a] += n
    p = {k: np.log(t / t.sum(1, keepdims=True)) for k, t in table.items()}
    return {(r, a): float(p[0][0, r] + p[0][1, a] - p[2][0, r] - p[2][1, a]) for r in range(BINS + 1) for a in range(BINS + 1)}


def replicated(said: DataFrame, hosts: int) -> DataFrame:
    """(shingle, wide): the shingles of (shingle, host) rows that stand on `hosts` or more hosts."""
    if hosts == 2:  # two hosts are known by the smallest and the largest, so that every task sends a shingle once
        wide = said.groupBy("shingle").agg(F.min("host").alias("a"), F.max("host").alias("b")).where("a != b")
    else:
        wide = said.distinct().groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= hosts)
    return wide.select("shingle", F.lit(1).alias("wide"))


def stuffed(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", hosts: int = 2) -> DataFrame:
    """One row per page: n_words, list_words, open_words, replicated_share of its open shingles, open_odds, list_share, flagged.

    A page's open stretches count as lists if the calibrated odds of `replicated_share` (shingles on `hosts` or more hosts) and
    of the words that come again speak for it; without shingles they do not. Calibration and replication counts cover all
    pages. Pages delivered twice count once (the larger values of equal keys hold). NULL and empty texts have no words and are
    never flagged; a NULL host counts as a host of its own; a share of exactly one half is not flagged. Very long texts are
    read whole. Extra columns are ignored. An empty table gives no rows.
    """
    m = cut(measure(docs, key, text, host))
    if not m.groupBy(key).count().where("count > 1").isEmpty():  # else nothing but the keys need be shuffled
        m = cut(m.groupBy(key).agg(F.max(F.struct(*[c for c in m.columns if c != key])).alias("x")).select(key, "x.*"))
    asked = m.select(key, F.explode(F.arrays_zip("shingles", "kinds")).alias("x")).where("x.kinds >= 0").select(key, F.col("x.kinds").alias("kind"), F.col("x.shingles").alias("shingle"))
    wide = replicated(m.select(F.xxhash64(F.coalesce("host", F.lit(""))).alias("host"), F.explode("shingles").alias("shingle")), hosts)
    shares = cut(asked.join(wide, "shingle", "left").groupBy(key, "kind").agg(F.avg(F.coalesce("wide", F.lit(0))).alias("replicated")))
    by_kind = m.select(key, *[F.col(f"{k}_again") for k in KINDS], *[F.col(f"{k}_words") for k in KINDS]).join(shares, key)
    again = F.when(F.col("kind") == 0, F.col("list_again")).otherwise(F.col("text_again"))
    words = F.when(F.col("kind") == 0, F.col("list_words")).otherwise(F.col("text_words"))
    seen = by_kind.where("kind != 1").groupBy("kind", _bin(F.col("replicated")).alias("r"), _bin(again).alias("a")).agg(F.sum(words).alias("n"))
    odds = calibrate([(r["kind"], r["r"], r["a"], float(r["n"])) for r in bounded_rows(seen, 2 * (BINS + 1) ** 2, "the calibration")])
    lookup = F.create_map(*[x for (r, a), v in odds.items() for x in (F.lit(r * (BINS + 1) + a), F.lit(v))])
    out = m.select(key, "n_words", "list_words", "open_words", "open_again").join(shares.where("kind = 1").select(key, F.col("replicated").alias("replicated_share")), key, "left")
    open_odds = F.when(F.col("replicated_share").isNotNull(), F.try_element_at(lookup, _bin(F.col("replicated_share")) * (BINS + 1) + _bin(F.col("open_again"))))
    out = out.withColumn("open_odds", open_odds)
    total = F.col("list_words") + F.when(F.col("open_odds") > 0, F.col("open_words")).otherwise(0)
    out = out.withColumn("list_share", F.when(F.col("n_words") > 0, total / F.col("n_words")).otherwise(0.0))
    return out.withColumn("flagged", F.col("list_share") > 0.5).drop("open_again")
