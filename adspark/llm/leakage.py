"""Evaluation texts leaking into a corpus (problem 9).

Items and documents are brought to the same canonical template: hyphenated line ends joined, page lines dropped, spelling
folded, figures replaced by a number slot, units by a unit slot, and words outside the items' common vocabulary (names and
misread words) by a name slot. Windows of `window` template words of all items form the build side of a hash join; it is a
reference table of proven size, so it is sent to every task and each document's windows probe it as they are made. Nothing
of the corpus is shuffled but the hits. Pairs of neighbouring folded words, rare ones included, are indexed beside the
templates, and a place needs no more of them than a quoted stretch of the least length keeps when `1 - DENSE` of its words
are changed.

Items of which a document might repeat half are not left to windows: an alignment cannot match more words than the document
and the item have in common, nor more than their longest common subsequence, so every item that reaches the least number by
both bounds is aligned, wherever its words stand.

A document that may repeat an item is aligned with it, word by word: a local alignment finds the stretch in which the item's
words follow in order. Words match if they are equal after folding or within the edits of a misreading. The slots inside the
stretch are checked for consistency: `slots_equal` tells how many numbers, units and names agree, and `renamed` how many
words of the item stand in slots that are filled anew in one consistent way, as in a re-parameterised question: one value
always became the same other one, no two became the same, and a name counts only if its change is confirmed by a second
place, since any other content word would pass for a name. Such words count as repeated where the rest of the stretch is the
item's template word for word; so a question asked again with other numbers is found, other sentences on its subject are not.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.runtime import Shared, bounded_rows, spread

HYPHEN = regex.compile(r"(?<=\p{L})[-⸗¬=]\s*\n\s*(?=\p{L})")
PAGE_LINE = regex.compile(r"^[\s\p{P}\p{S}]*(?:\p{N}{1,4}|(?:seite|nr|pag|page|pagina|strana)\.?\s*\p{N}{1,4})[\s\p{P}\p{S}]*$", regex.I | regex.M)
WORD = regex.compile(r"[\p{L}\p{M}]+|\p{N}+")
# What counts as repeated: a stretch over this part of an item, with this part of its words agreeing.
HALF, DENSE = 0.5, 0.72
TEMPLATE = 0.9  # part of the words outside slots that must be the item's where slots are filled anew
MISS, GAP = 0.5, 0.4  # what a changed word and a missing or added one cost an alignment
SLOT = {"number": "\x01", "unit": "\x02", "name": "\x03"}
# Words for units of measure, money and time, as folded by fold().
UNITS = frozenset("elen fuder schefel zuber strange eimer pfund zentner metzen klafter fl kr gulden kreuzer kronen heler mark wochen monate jahre tage stunden ells bushels tubs hanks weeks months years braci tini staia matase setimane mesi ani aunes boiseaux cuves semaines mois ans lokti meric kadi praden tydnu mesicu let".split())


def fold(word: str) -> str:
    """A word's spelling class: case, long s, umlauts, marks, historical letters and doubled letters do not matter."""
    w = word.lower().replace("ſ", "s").replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")
    if not w.isascii():
        w = unicodedata.normalize("NFD", w).replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    w = w.replace("th", "t").replace("ph", "f").replace("ck", "k").replace("y", "i").replace("ae", "e")
    return regex.sub(r"(.)\1", r"\1", w)


def words(text: str) -> list[str]:
    """The words and figures of a text, hyphenated line ends joined and lines that hold only a page number dropped."""
    t = HYPHEN.sub("", PAGE_LINE.sub("", text) if "\n" in text else text)
    return WORD.findall(t)


class Items:
    """The items' template windows and vocabulary, sent to every task."""

    def __init__(self, rows: list[tuple[int, str]], window: int, common: int = 3):
        self.ids = [i for i, t in rows if t]
        self.window = window
        memo: dict[str, str] = {}
        self.folded = [[memo.setdefault(w, fold(w)) for w in words(t)] for _, t in rows if t]
        df: Counter = Counter()
        for ws in self.folded:
            df.update(set(ws))
        least = min(common, max(1, len(self.ids) // 10))
        self.common = {w for w, n in df.items() if n >= least and not w.isdigit()}
        self.vocab = {w: k for k, w in enumerate(sorted(df))}
        self.near: dict[str, set[str]] = defaultdict(set)
        for w in self.vocab:
            if len(w) >= 4:
                for d in _deletes(w, 2 if len(w) >= 8 else 1):
                    self.near[d].add(w)
        self.coded = [np.array([self.vocab[w] for w in ws], np.int32) for ws in self.folded]
        self.index: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for n, ws in enumerate(self.folded):
            t = [self.template(w) for w in ws]
            for p in range(max(1, len(t) - window + 1)):
                key = tuple(t[p : p + window])
                if sum(x not in SLOT.values() for x in key) >= min(3, len(t)):
                    self.index[key].append((n, p))
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        self.masks: list[dict[int, int]] = []
        post: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, c in enumerate(self.coded):
            at: dict[int, int] = defaultdict(int)
            ks = c.tolist()
            for p, w in enumerate(ks):
                at[w] |= 1 << p
            for p, pair in enumerate(zip(ks, ks[1:], strict=False)):
                self.pairs[pair].append((n, p))
            for w, bits in at.items():
                post[w] += [(n, k) for k in range(bits.bit_count())]
            self.masks.append(dict(at))
        # Items that hold a word once, twice and so on, each level with all that reach it.
        self.post = {w: [np.array([n for n, k in x if k == j], np.int32) for j in range(1 + max(k for _, k in x))] for w, x in post.items()}
        self.need = np.array([math.ceil(HALF * DENSE * len(c) - 1e-9) for c in self.coded])
        self.memo: dict[str, tuple[str, int]] = {}

    def template(self, folded: str) -> str:
        if folded[0].isdigit():
            return SLOT["number"]
        if folded in UNITS:
            return SLOT["unit"]
        return folded if folded in self.common else SLOT["name"]

    def known(self, folded: str) -> str:
        """The item word that a folded word is or misreads, else itself."""
        if folded in self.vocab or len(folded) < 4 or folded[0].isdigit():
            return folded
        best = None
        for d in _deletes(folded, 2 if len(folded) >= 8 else 1):
            for w in self.near.get(d, ()):
                c = _edits(folded, w)
                if c <= (1 if len(w) < 6 else 2 if len(w) < 10 else 3) and (best is None or (c, w) < best):
                    best = (c, w)
        return best[1] if best else folded

    def encode(self, word: str) -> tuple[str, int]:
        """Template word and vocabulary number (-1: none) of a document's word."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            k = self.known(fold(word))
            got = self.memo[word] = (self.template(k), self.vocab.get(k, -1))
        return got


def _deletes(s: str, k: int) -> set[str]:
    level, out = {s}, {s}
    for _ in range(k):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out |= level
    return out


def _edits(a: str, b: str, most: int = 3) -> int:
    """Levenshtein distance, `most` + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        if min(cur) > most:
            return most + 1
        prev = cur
    return prev[-1]


def align(item: np.ndarray, doc: np.ndarray, miss: float = MISS, gap: float = GAP) -> tuple[int, list[tuple[int, int]]]:
    """Best local alignment (match 1): number of matched words and the aligned pairs (item position, document position)."""
    n, m = len(item), len(doc)
    if not n or not m:
        return 0, []
    h = np.zeros((n + 1, m + 1))
    ramp = gap * np.arange(m + 1)
    for i in range(n):
        c = np.zeros(m + 1)
        c[1:] = np.maximum(h[i, :-1] + np.where(doc == item[i], 1.0, -miss), h[i, 1:] - gap)
        np.maximum(c, 0, out=c)
        h[i + 1] = np.maximum.accumulate(c + ramp) - ramp
        np.maximum(h[i + 1], 0, out=h[i + 1])
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    pairs = []
    while i and j and h[i, j] > 1e-9:
        s = 1.0 if doc[j - 1] == item[i - 1] else -miss
        if abs(h[i, j] - (h[i - 1, j - 1] + s)) < 1e-9:
            pairs.append((int(i) - 1, int(j) - 1))
            i, j = i - 1, j - 1
        elif abs(h[i, j] - (h[i - 1, j] - gap)) < 1e-9:
            i -= 1
        else:
            j -= 1
    pairs.reverse()
    return sum(doc[q] == item[p] for p, q in pairs), pairs


def common(hits: list[tuple[int, int]], size: int) -> int:
    """Length of the longest common subsequence of a document and an item, from (document position, bits of the item's
    positions that hold this word), in order."""
    v = full = (1 << size) - 1
    for _, bits in hits:
        u = v & bits
        if u:
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def repeats(matched: float, coverage: float) -> bool:
    """Whether a stretch is repeated in the sense of `found`, slots filled anew aside."""
    return coverage >= HALF and (matched >= HALF or matched >= DENSE * coverage)


def stretches(item: np.ndarray, numbers: np.ndarray, hits: list[tuple[int, int]], lo: int, hi: int, need: int) -> Iterator[tuple]:
    """Alignments in numbers[lo:hi], and beside each that is not repeated, while `need` words in order are possible there."""
    size = len(item)
    within = hits[bisect_left(hits, (lo, 0)) : bisect_left(hits, (hi, 0))]
    if len(within) < need:
        return
    shared = common(within, size)
    if shared < need:
        return
    # An alignment with more added words than this would score below nothing, so each lies whole in one of the parts.
    most = shared + math.ceil(shared / GAP)
    step = max(1, most // 4)
    if hi - lo > most + step:
        for at in range(lo, hi - most, step):
            yield from stretches(item, numbers, within, at, min(hi, at + step + most), need)
        return
    matched, pairs = align(item, numbers[lo:hi])
    if pairs:
        yield matched, pairs, lo
        if not repeats(matched / size, (pairs[-1][0] - pairs[0][0] + 1) / size):
            yield from stretches(item, numbers, hits, lo, lo + pairs[0][1], need)
            yield from stretches(item, numbers, hits, lo + pairs[-1][1] + 1, hi, need)


def halves(items: Items, numbers: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """(item, alignment) wherever at least half of an item may be repeated."""
    codes = [(p, w) for p, w in enumerate(numbers.tolist()) if w >= 0]
    if not codes:
        return
    post = items.post
    shared = np.bincount(np.concatenate([x for w, k in Counter(w for _, w in codes).items() for x in post[w][:k]]), minlength=len(items.coded))
    for n in np.nonzero(shared >= items.need)[0].tolist():
        masks, need = items.masks[n], int(items.need[n])
        hits = [(p, masks[w]) for p, w in codes if w in masks]
        for x in stretches(items.coded[n], numbers, hits, 0, len(numbers), need):
            yield n, x


def leaks_in(text: str, items: Items, least: float) -> list[dict]:
    """The items of which a text repeats a stretch: coverage, matched words, place, and agreement of slots."""
    ws = words(text)
    if not ws:
        return []
    coded = [items.encode(w) for w in ws]
    template = [t for t, _ in coded]
    k = items.window
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    index = items.index
    for p in range(max(1, len(ws) - k + 1)):
        for n, q in index.get(tuple(template[p : p + k]), ()):
            hits[n].append((p, q))
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, pair in enumerate(zip(coded, coded[1:], strict=False)):
        for n, q in items.pairs.get((pair[0][1], pair[1][1]), ()):
            near[n].append((p, q))
    numbers = np.array([v for _, v in coded], np.int32)
    whole: dict[int, list[tuple]] = defaultdict(list)
    for n, x in halves(items, numbers):
        whole[n].append(x)
    out = []
    none: set[int] = set()
    for n in sorted(hits.keys() | near.keys() | whole.keys()):
        item = items.coded[n]
        size = len(item)
        # Each changed word spoils two pairs of the shortest stretch that counts, and moves the rest by one place at most.
        short = math.ceil(least * size)
        changed = int((1 - DENSE) * short)
        enough = max(1, short - 1 - 2 * changed)
        if n not in hits and n not in whole and len(near[n]) < enough:
            continue
        # Windows vote for the place where the item would begin; votes of one place lie within a fifth of its length.
        slack = max(6, size // 5)
        votes = Counter((p - q) // slack for p, q in hits.get(n, ()))
        starts = {s for s in votes if votes[s] + votes[s + 1] >= max(1, int(0.08 * size))}
        paired: dict[int, set[int]] = defaultdict(set)
        for p, q in near.get(n, ()):
            paired[(p - q) // (changed + 1)].add(q)
        starts |= {s * (changed + 1) // slack for s, qs in paired.items() if len(qs | paired.get(s + 1, none)) >= enough}
        found = whole.get(n, [])
        for s in sorted(starts):
            lo, hi = max(0, (s - 1) * slack), (s + 3) * slack + size + size // 3
            if hi <= 0:
                continue
            matched, pairs = align(item, numbers[lo:hi])
            if pairs:
                found.append((matched, pairs, lo))
        best = None
        for matched, pairs, lo in sorted(found, key=lambda x: x[2] + x[1][0][1]):
            span = pairs[-1][0] - pairs[0][0] + 1
            cand = (repeats(matched / size, span / size), matched, span, lo + pairs[0][1], lo + pairs[-1][1], lo, pairs)
            best = cand if best is None or cand[:3] > best[:3] else best
        if best is None:
            continue
        _, matched, span, first, last, lo, pairs = best
        if span < least * size:
            continue
        folded = items.folded[n]
        equal, slots, renamed = refilled(items, folded, [items.known(fold(w)) for w in ws[lo + pairs[0][1] : lo + pairs[-1][1] + 1]], pairs)
        out.append({"item_id": int(items.ids[n]), "coverage": span / size, "matched": matched / size, "first_word": first, "last_word": last, "slots_equal": equal / slots if slots else 1.0, "renamed": renamed / size})
    return out


def refilled(items: Items, item: list[str], doc: list[str], pairs: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Equal slots, all slots, and slots consistently filled anew of an alignment; `doc` holds the stretch's words only.

    None is filled anew unless nearly all words outside the slots (TEMPLATE) are the item's.
    """
    first = pairs[0][1]
    equal = slots = fixed = kept = 0
    changed: Counter = Counter()
    became: dict[str, set[str]] = defaultdict(set)
    was: dict[str, set[str]] = defaultdict(set)
    for p, q in pairs:
        a, b = item[p], doc[q - first]
        t = items.template(a)
        if t not in SLOT.values():
            fixed += 1
            kept += a == b
            continue
        slots += 1
        equal += a == b
        if t == items.template(b):
            changed[a, b] += a != b
            became[a].add(b)
            was[b].add(a)
    if kept < TEMPLATE * fixed or fixed < 2:
        return equal, slots, 0
    ok = [n for (a, b), n in changed.items() if n and len(became[a]) == len(was[b]) == 1 and (n > 1 or items.template(a) != SLOT["name"])]
    return equal, slots, sum(ok)


LEAK = "item_id bigint, coverage double, matched double, first_word int, last_word int, slots_equal double, renamed double"


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = 4, least: float = 0.25, bound: int = 100_000) -> DataFrame:
    """One row per (document, item) that share a stretch of at least `least` of the item's words.

    `coverage` is the part of the item from its first to its last aligned word, `matched` the part whose words really agree,
    `renamed` the part whose slots are consistently filled anew.
    Documents or items delivered twice count once (a repeated half, then the fullest match holds). NULL and empty texts have no leaks, NULL items
    are skipped; very long texts are searched whole; ties between places go to the earlier one. Extra columns are ignored.
    Empty tables give no rows. More than `bound` items raise: the build side must fit every task.
    """
    rows = sorted({(r["item_id"], r["text"]) for r in bounded_rows(items.select("item_id", "text"), bound, "the items") if r["item_id"] is not None and r["text"]})
    shared = Shared(docs.sparkSession, Items(rows, window))
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    names = [c.split()[0] for c in LEAK.split(", ")]
    types = [pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its = shared.value
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                for leak in leaks_in(t or "", its, least):
                    at.append(i)
                    found.append(leak)
            keys = b.column("k").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([f[c] for f in found], ty) for c, ty in zip(names, types, strict=True)]], names=["k", *names])

    fullest = F.struct(_repeated().alias("repeated"), "matched", "coverage", "first_word", "last_word", "slots_equal", "renamed")
    out = spread(src).mapInArrow(run, f"k {kind}, {LEAK}").groupBy("k", "item_id").agg(F.max(fullest).alias("x"))
    return out.select(F.col("k").alias(key), "item_id", "x.*").drop("repeated")


def _repeated(half: float = HALF, dense: float = DENSE) -> Column:
    agree = F.col("matched") + F.col("renamed")
    return (F.col("coverage") >= half) & ((agree >= half) | (agree >= F.lit(dense) * F.col("coverage")))


def found(leaked: DataFrame, key: str = "doc_id", half: float = HALF, dense: float = DENSE) -> DataFrame:
    """(key, item_id): the document repeats at least half of the item's words in order and in one stretch.

    Single changed, missing or misread words do not count against a stretch, and slots that are consistently filled anew are
    repeated words: it also holds if it reaches over half of the item and at least `dense` of its words agree, as they do not
    in other sentences on the same subject.
    """
    return leaked.where(_repeated(half, dense) & F.col(key).isNotNull()).select(key, "item_id")
