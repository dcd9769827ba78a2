"""Free-entered values mapped to a reference list, with the misses reported (problem 6).

A symmetric-delete dictionary of the reference spellings (titles, female forms, aliases, value names; a reference table of
proven size) is sent to every task. A lookup generates the deletes of the query, takes the spellings that share one and lie
within the bound (none, one or two edits, by length, for which the deletes of both sides are exact), and ranks them by weighted
Damerau-Levenshtein distance, then by how often the reference entry is named exactly in the data. Cheap edits are the
confusions of print recognition and of historical spelling; everything else costs one. A misread letter group ("rn" for "m")
is undone first where there is one, so that it does not use up the bound.

Free text needs more than one lookup: a surface may name several jobs, wrap them in numbers, adjectives, places and
compounds ("zwei geübte Köchinnen für ...", "Kutscher-Posten"), or abbreviate them ("Stubenm."). The parts are tried
in turn. Where the form says nothing, hints decide: a position's `entries`, and for tags the phrases of other rows: a value
that stands for phrases which elsewhere carry one and the same reference value is that value's synonym.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspark.runtime import Shared, bounded_bytes, bounded_rows, cut

# Groups of letters that print recognition confuses; an edit inside a group costs half.
CONFUSED = ["ceo", "nu", "nrm", "rvt", "rt", "rn", "hb", "hk", "il1jt", "sf", "ao0", "gq9", "dbo", "bv", "kr", "gs", "mn", "uü", "aä", "oö", "zc", "ck", "yi", "cz", "li", "tf", "pb", "td", "vw"]
# Letter groups that stand for one another in misread words.
MERGED = [("m", "rn"), ("m", "in"), ("m", "nr"), ("n", "ii"), ("ü", "ii"), ("d", "cl"), ("w", "vv"), ("ck", "d"), ("h", "li"), ("k", "lc"), ("b", "lo"), ("g", "cr"), ("ch", "eb"), ("ch", "ob"), ("sch", "fch")]
CHEAP = {frozenset(p) for g in CONFUSED for p in itertools.combinations(g, 2)}
# Words that join jobs, and words that begin what is no longer part of the job.
JOINERS = regex.compile(r"\s+(?:und|u\.?|oder|od\.?|sowie|resp\.?|bezw\.?|beziehungsweise|auch|zugleich|et)\s+|\s*[/;+&]\s*", regex.I)
TAIL = regex.compile(r"\s+(?:in|im|für|fuer|bei|beim|zu|zum|zur|nach|auf|aus|mit|ohne|am|an|von|der|des|gesucht|sucht)\s.*$", regex.I)
SUFFIX = regex.compile(r"[\s-]*(?:stelle|stellen|posten|platz|plätze|dienst|stellung|arbeit)\.?$", regex.I)
PAREN = regex.compile(r"\([^)]*\)|\[[^\]]*\]")
# What a tag value may be wrapped in.
WRAP = {"sehr", "gut", "gute", "guter", "gutes", "guten", "bevorzugt", "erwünscht", "kann", "spricht", "etwas", "perfekt", "perfect", "flink", "flinke", "flinkes", "womöglich", "sprache", "sprachen"}


def plain(s: str) -> str:
    """NFC, lower case, long s as s, digits that stand in words as letters, outer marks and runs of blanks away."""
    s = unicodedata.normalize("NFC", s).lower().replace("ſ", "s").replace("⸗", "-").replace("¬", "-")
    s = regex.sub(r"(?<=\p{L})[1|](?=\p{L})|^[1|](?=\p{L}{3})|(?<=\p{L}{3})[1|]$", "l", s)
    s = regex.sub(r"(?<=\p{L})0(?=\p{L})|^0(?=\p{L}{3})|(?<=\p{L}{3})0$", "o", s)
    return regex.sub(r"\s+", " ", s).strip(" \t,;:!?\"'„“»«_*-")


def fold(s: str) -> str:
    """Spelling classes: what differs only by historical spelling folds to the same string."""
    s = s.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss").replace("th", "t").replace("ph", "f").replace("y", "i")
    s = regex.sub(r"c(?=[eiy])", "z", s).replace("ck", "k")
    s = regex.sub(r"c(?!h)", "k", s)
    return s


def distance(a: str, b: str, most: float = 3.0) -> float:
    """Weighted Damerau-Levenshtein distance (adjacent transpositions); `most` + 1 where it is larger than `most`."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > 2 * most:
        return most + 1
    prev2: list[float] = []
    prev = [0.0] + [_gap(b, j) for j in range(len(b))]
    prev = list(itertools.accumulate(prev))
    for i, x in enumerate(a):
        cur = [prev[0] + _gap(a, i)]
        for j, y in enumerate(b):
            c = prev[j] + (0.0 if x == y else 0.5 if frozenset((x, y)) in CHEAP else 1.0)
            c = min(c, prev[j + 1] + _gap(a, i), cur[j] + _gap(b, j))
            if i and j and x == b[j - 1] and a[i - 1] == y and x != y:
                c = min(c, prev2[j - 1] + 0.7)
            cur.append(c)
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return prev[-1]


def _gap(s: str, i: int) -> float:
    """Cost of a letter that the other side lacks: half where it doubles its neighbour."""
    return 0.5 if (i and s[i - 1] == s[i]) or (i + 1 < len(s) and s[i + 1] == s[i]) else 1.0


def merged(s: str) -> list[str]:
    """The string and what it may be if one pair of letter groups was misread, at every place where one stands."""
    out = [s]
    for one, many in MERGED:
        for x, y in ((one, many), (many, one)):
            at = s.find(x)
            while at >= 0:
                out.append(s[:at] + y + s[at + len(x):])
                at = s.find(x, at + 1)
    return list(dict.fromkeys(out))


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent transpositions), `most` + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        cur = [i + 1]
        for j, y in enumerate(b):
            c = min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                c = min(c, prev2[j - 1] + 1)
            cur.append(c)
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return prev[-1]


def reachable(n: int) -> int:
    """The bound of a lookup for a word of n letters: so many edits, and so many deletes on either side, reach every spelling in it."""
    return 0 if n <= 3 else 1 if n <= 5 else 2


def deletes(s: str, k: int) -> set[str]:
    """The string and all strings with up to k letters taken out."""
    level, out = {s}, {s}
    for _ in range(k):
        level = {t[:i] + t[i + 1:] for t in level for i in range(len(t))}
        out |= level
    return out


def negated(word: str, spelled: str) -> bool:
    """Whether the word is the spelling with a prefix of negation: that is no misspelling of it."""
    return word.startswith("un") and not spelled.startswith("un") and word[2:4] == spelled[:2]


def allowed(n: int) -> float:
    """The largest weighted distance at which a word of n letters still names a spelling."""
    return 0.0 if n <= 3 else 1.0 if n <= 5 else 1.5 if n <= 7 else 2.0


class Spellings:
    """The symmetric-delete dictionary of one list: spellings of reference ids."""

    def __init__(self, entries: Iterable[tuple[int, str]], frequency: dict[int, int] | None = None):
        self.by: dict[str, set[int]] = defaultdict(set)
        for ref, s in entries:
            if s and plain(s):
                self.by[fold(plain(s))].add(ref)
                self.by[plain(s)].add(ref)
        self.frequency = frequency or {}
        self.index: dict[str, set[str]] = defaultdict(set)
        for f in self.by:
            for d in deletes(f, reachable(len(f))):
                self.index[d].add(f)
        self.heads: dict[str, set[str]] = defaultdict(set)
        for f in self.by:
            self.heads[f[0]].add(f)
        # Spellings of several words by the number of their words.
        self.phrases: dict[int, list[tuple[str, list[str]]]] = defaultdict(list)
        for f in self.by:
            words = regex.split(r"[\s-]+", f)
            self.phrases[len(words)].append((f, words))
        self.memo: dict[str, tuple[float, int] | None] = {}
        self.values: dict[str, int] = {}

    def _ref(self, f: str) -> int:
        return min(self.by[f], key=lambda r: (-self.frequency.get(r, 0), r))

    def exact(self, word: str) -> int | None:
        f = fold(plain(word))
        return self._ref(f) if f in self.by else None

    def near(self, word: str) -> tuple[float, int] | None:
        """The nearest spelling within the allowed distance: (distance, reference id)."""
        p = plain(word).rstrip(".")
        if p not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = [n for f in {fold(p), p} if (n := self._near(f))]
            self.memo[p] = min(found, default=None)
        return self.memo[p]

    def _near(self, f: str) -> tuple[float, int] | None:
        if len(f) < 2:
            return None
        if f in self.by:
            return 0.0, self._ref(f)
        best = None
        for v in merged(f):
            extra = 0.0 if v == f else 0.5
            seen = {s for d in deletes(v, reachable(len(v))) for s in self.index.get(d, ())}
            for s in seen:
                n = min(len(f), len(s))
                if negated(v, s) or edits(v, s, reachable(n)) > reachable(n):
                    continue
                c = distance(v, s, 2.5) + extra
                if c <= allowed(n):
                    key = (c, -self.frequency.get(self._ref(s), 0), self._ref(s))
                    best = key if best is None or key < best else best
        return None if best is None else (best[0], best[2])

    def abbreviated(self, word: str, dotted: bool) -> list[int]:
        """References that the word may abbreviate: a dotted beginning, or the letters of a spelling in order, by frequency."""
        f = fold(plain(word).rstrip("."))
        if len(f) < 2:
            return []
        first = [s for s in self.heads.get(f[0], ()) if s.startswith(f) and len(s) > len(f)] if dotted else []
        if not first and dotted and len(f) >= 4:
            first = [s for s in self.heads.get(f[0], ()) if len(s) > len(f) and distance(f, s[: len(f)], 1.5) <= 1.0]
        if not first:
            first = [s for s in self.heads.get(f[0], ()) if len(s) > len(f) and _within(f, s)] if len(f) >= 3 and not regex.search("[aeiou]", f) else []
        return sorted({self._ref(s) for s in first}, key=lambda r: (-self.frequency.get(r, 0), r))


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def name_jobs(surface: str, hints: list[list[str]], forms: Spellings) -> list[tuple[int, float]]:
    """The jobs a surface names, in order: (reference id or 0, distance). `hints`: per entry its term, lemma and modern."""
    text = PAREN.sub(" ", unicodedata.normalize("NFC", surface).replace("\n", " "))
    ref = forms.exact(text)
    if ref is not None:
        return [(ref, 0.0)]
    parts = [p for p in JOINERS.split(text) if plain(p)]
    hinted = [next((n[1] for w in h if w and (n := forms.near(w)) and n[0] <= 1.0), None) for h in hints]
    out: list[tuple[int, float]] = []
    for i, part in enumerate(parts):
        hint = hinted[i] if i < len(hinted) and len(hinted) == len(parts) else None
        got = _one_job(part, hint, forms)
        if got is None and len(parts) == 1 and len(set(hinted)) == 1 and hinted[0] is not None and _looks_like(part, hinted[0], forms):
            got = (hinted[0], 3.0)
        out.append(got or (0, 9.0))
    return out or [(0, 9.0)]


def _one_job(part: str, hint: int | None, forms: Spellings) -> tuple[int, float] | None:
    head = TAIL.sub("", " " + part).strip() or part.strip()
    pieces = [p for p in regex.split(r"\s*,\s*", head) if plain(p)]
    best: tuple[float, int] | None = None
    for piece in pieces:
        tries = [piece, SUFFIX.sub("", piece)] + [t for w in regex.split(r"[\s]+", piece) for t in (w, SUFFIX.sub("", w))]
        tries += [t for w in regex.split(r"[\s-]+", piece) for t in (w,)]
        for t in dict.fromkeys(tries):
            if len(plain(t)) >= 3 and (n := forms.near(t)):
                short = forms.abbreviated(t, True) if n[0] and plain(t).endswith(".") else []
                if short:  # "Zimmerm." is nearer to what it begins than to what it resembles
                    n = (0.5, hint if hint in short else short[0])
                key = (n[0] - (0.4 if n[1] == hint else 0.0), n[1])
                best = key if best is None or key < best else best
        if best:
            return best[1], max(best[0], 0.0)
    for piece in pieces:
        for w in regex.split(r"\s+", piece):
            w = w.strip(",;:()")
            if len(plain(w)) >= 2 and (w.endswith(".") or len(plain(w)) >= 3):
                refs = forms.abbreviated(w, w.endswith("."))
                if refs:
                    return (hint if hint in refs else refs[0]), 1.0
    # A compound whose last part is a listed job ("Haupt-...") is no spelling of it; only forms within the bound count.
    return None


def _looks_like(part: str, ref: int, forms: Spellings) -> bool:
    """Whether a hinted entry is plausible for a surface that no lookup could place: a spelling of it within a wider bound."""
    words = [fold(plain(w)) for w in regex.split(r"[\s,]+", TAIL.sub("", " " + part))]
    words += [fold(plain(SUFFIX.sub("", w))) for w in regex.split(r"[\s,]+", part)]
    spelled = [f for f, refs in forms.by.items() if ref in refs]
    return any(len(w) >= 4 and distance(w, f, 4.0) <= 0.4 * len(f) for w in words for f in spelled)


def value_of(value: str, forms: Spellings) -> int:
    """As name_value, each distinct value looked up once in a task."""
    got = forms.values.get(value)
    if got is None:
        if len(forms.values) > 200_000:
            forms.values.clear()
        got = forms.values[value] = name_value(value, forms)
    return got


def name_value(value: str, forms: Spellings) -> int:
    """The reference value that a tag value spells, 0 if none: the whole, its core, or its words one by one."""
    whole = forms.near(PAREN.sub(" ", value))
    if whole:
        return whole[1]
    core = regex.split(r"\s*[,;(]\s*", value)[0]
    words = [w for w in regex.split(r"[\s-]+", core) if plain(w) and plain(w).rstrip(".") not in WRAP]
    if not words:
        return 0
    got = forms.near(" ".join(words)) or forms.near("-".join(words))
    if got:
        return got[1]
    best: list[tuple[float, int]] = []
    for f, target in forms.phrases.get(len(words), ()):
        cost = 0.0
        for w, t in zip(words, target, strict=True):
            cost += _word_cost(w, t)
            if cost > len(words):
                break
        else:
            best.append((cost, forms._ref(f)))
    if best:
        return min(best, key=lambda x: (x[0], -forms.frequency.get(x[1], 0), x[1]))[1]
    return 0


def _word_cost(word: str, target: str) -> float:
    w, dotted = fold(plain(word).rstrip(".")), plain(word).endswith(".") or word.endswith(".")
    if w == target:
        return 0.0
    if dotted and len(w) >= 1 and target.startswith(w):
        return 0.5
    if dotted and len(w) >= 4 and distance(w, target[: len(w)], 1.5) <= 1.0:
        return 0.9
    if len(w) >= 2 and w[0] == target[0] and not regex.search("[aeiou]", w) and _within(w, target) and target[: len(w)] != w:
        return 0.8
    if negated(w, target):
        return 99.0
    d = distance(w, target, 2.5)
    return d / 2 if d <= allowed(min(len(w), len(target))) else 99.0


REFERENCE_BYTES = 16 << 20  # the deletes of a spelling take some hundred times its room
JOB = T.ArrayType(T.StructType([T.StructField("ref_id", T.LongType()), T.StructField("cost", T.DoubleType())]))


def map_positions(position_dict: DataFrame, titles: DataFrame, bound: int = 100_000) -> DataFrame:
    """(row_id, item_no, ref_id, cost, exact): one row per job named in a surface; ref_id 0 reports a miss.

    `exact` tells that the whole surface is a title or female title as listed. Rows delivered twice count once. NULL and
    empty surfaces name nothing and give no row; NULL entries give no hints; ties go to the reference entry more often named
    exactly, then to the smaller id. Very long surfaces are read whole. Extra columns are ignored; empty tables give no rows,
    an empty reference list makes every surface a miss. More than `bound` reference rows raise: they are no reference list.
    """
    ref = bounded_rows(titles.select("title_id", "title", "female_title", "aliases"), bound, "the reference list")
    spelled = [(r["title_id"], s) for r in ref for s in (r["title"], r["female_title"], *(r["aliases"] or []))]
    bounded_bytes(ref, REFERENCE_BYTES, "the reference list")
    listed = titles.select(F.explode(F.array("title", "female_title")).alias("surface")).where("surface is not null").distinct().withColumn("listed", F.lit(True))
    rows = position_dict.select("form_id", "surface", "entries").dropDuplicates(["form_id"]).where("form_id is not null and surface is not null and trim(surface) <> ''")
    rows = rows.join(F.broadcast(listed), "surface", "left")  # as many rows as the list has names
    named = rows.where("listed").groupBy("surface").agg(F.count("*").alias("n"))
    seen = {r["surface"]: r["n"] for r in named.collect()}
    often: dict[int, int] = defaultdict(int)
    for i, s in spelled:
        often[i] += seen.get(s, 0)
    forms = Spellings(spelled, dict(often))
    shared = Shared(rows.sparkSession, forms)

    @F.pandas_udf(JOB)
    def jobs(surface: pd.Series, hints: pd.Series) -> pd.Series:
        f = shared.value
        return pd.Series([[{"ref_id": r, "cost": c} for r, c in name_jobs(s, [list(x) for x in h] if h is not None else [], f)] for s, h in zip(surface, hints, strict=True)])

    hint = F.transform(F.coalesce("entries", F.array()), lambda e: F.array(e["lemma"], e["term"], e["modern"]))
    out = rows.select("form_id", "listed", F.posexplode(jobs("surface", hint)).alias("at", "j"))
    exact = F.coalesce("listed", F.lit(False))
    return out.select(F.col("form_id").alias("row_id"), (F.col("at") + 1).cast("int").alias("item_no"), F.col("j.ref_id").alias("ref_id"), F.col("j.cost").alias("cost"), exact.alias("exact"))


def map_tags(requirement_dict: DataFrame, values: DataFrame, bound: int = 100_000, least: int = 2, purity: float = 0.7, spread: int = 3) -> DataFrame:
    """(row_id, item_no, ref_id, exact, by): one row per tag with a value; `by` is 'form', 'phrase' or 'none' (a miss, id 0).

    Values that no spelling explains are looked up through the phrases of their rows: at least `least` single-tag rows must
    point to reference values through equal phrases, `purity` of them to one; a value that occurs in `spread` or more
    dimensions names none of them. NULL and empty values give no row; the other cases are defined as for positions.
    """
    ref = bounded_rows(values.select("value_id", "dimension", "value_name"), bound, "the reference list")
    rows = requirement_dict.select("req_id", "surface", "tags").dropDuplicates(["req_id"]).where("req_id is not null")
    tag = rows.select("req_id", "surface", F.size("tags").alias("n_tags"), F.posexplode("tags").alias("at", "t")).select("req_id", "surface", "n_tags", (F.col("at") + 1).cast("int").alias("item_no"), F.col("t.dimension").alias("dimension"), F.col("t.value").alias("value"))
    tag = tag.where("value is not null and trim(value) <> ''")
    bounded_bytes(ref, REFERENCE_BYTES, "the reference list")
    names = values.where("value_id is not null").groupBy("dimension", F.col("value_name").alias("value")).agg(F.min("value_id").cast("long").alias("named"))
    tag = tag.join(F.broadcast(names), ["dimension", "value"], "left")  # as many rows as the list
    often = {r["named"]: r["n"] for r in tag.where("named is not null").groupBy("named").agg(F.count("*").alias("n")).collect()}  # at most as many rows as the list
    lists = {d: Spellings([(r["value_id"], r["value_name"]) for r in ref if r["dimension"] == d], often) for d in {r["dimension"] for r in ref}}
    shared = Shared(rows.sparkSession, lists)

    @F.pandas_udf(T.LongType())
    def spell(dimension: pd.Series, value: pd.Series) -> pd.Series:
        ls = shared.value
        return pd.Series([value_of(v, ls[d]) if d in ls else 0 for d, v in zip(dimension, value, strict=True)], dtype="int64")

    tag = cut(tag.withColumn("spelled", F.when(F.col("named").isNull(), spell("dimension", "value")).otherwise(F.col("named"))))
    key = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce("surface", F.lit(""))), "ſ", "s"), r"[^\p{L}\p{N}]+", " "))
    norm = F.regexp_replace(F.lower(F.trim("value")), r"[.\s]+$", "")
    single = tag.where("n_tags = 1").select("dimension", key.alias("phrase"), norm.alias("norm"), "spelled").where("phrase <> ''")
    # What a phrase means elsewhere: its most frequent reference value, pre-aggregated, so hot phrases are one row per value.
    means = single.where("spelled > 0").groupBy("dimension", "phrase", "spelled").agg(F.count("*").alias("n")).groupBy("dimension", "phrase").agg(F.max_by("spelled", F.struct("n", -F.col("spelled"))).alias("ref"))
    asked = single.where("spelled = 0").groupBy("dimension", "norm", "phrase").agg(F.count("*").alias("n"))
    told = asked.join(means, ["dimension", "phrase"]).groupBy("dimension", "norm", "ref").agg(F.sum("n").alias("n"))
    drawn = told.groupBy("dimension", "norm").agg(F.sum("n").alias("total"), F.max(F.struct("n", -F.col("ref"))).alias("top"))
    wide = tag.where("spelled = 0").select(norm.alias("norm"), "dimension").distinct().groupBy("norm").agg(F.count("*").alias("dims")).where(F.col("dims") < spread).select("norm")
    learned = drawn.where((F.col("top.n") >= least) & (F.col("top.n") >= F.lit(purity) * F.col("total"))).join(wide, "norm", "left_semi").select("dimension", "norm", (-F.col("top.col2")).alias("learned"))
    out = tag.withColumn("norm", norm).join(learned, ["dimension", "norm"], "left")
    id_ = F.when(F.col("spelled") > 0, F.col("spelled")).otherwise(F.coalesce("learned", F.lit(0)))
    by = F.when(F.col("spelled") > 0, "form").when(F.col("learned").isNotNull(), "phrase").otherwise("none")
    return out.select(F.col("req_id").alias("row_id"), "item_no", id_.cast("long").alias("ref_id"), F.col("named").isNotNull().alias("exact"), by.alias("by"), "dimension", "value")
