"""Text from scanned pages repaired into continuous paragraphs (problem 5).

Three averaged perceptrons, trained on the driver on a bounded sample of ads whose corrected text is known, predict the edit
operations of a page:

* lines: keep, or delete as page furniture (running headers, page numbers), from page position, shape of the line, the
  newspaper's known titles and whether the corrected text holds its words;
* line ends: keep the hyphen, or delete it and join the lines, from the marks, the neighbours and how often the joined and
  the hyphenated word occur in the collection;
* characters: at every letter of every word keep, replace, delete or insert; a sequence of operations is scored by its
  operations in context and by the word it leads to, one that the corrected text has and the scan lacks or one of the lexicon,
  and the best sequence wins against keeping all letters.

The corrected text is a second witness where there is one; the models are trained with it withheld from a third of the
sample, so that ads without one are judged by lexicon and operations alone. Word and title counts cover all ads.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.runtime import Shared, bounded_rows, cut, hash_below, spread

MARKS = "-⸗¬=‐‑­"
# Conjunctions of the five languages, before which a hyphen stands for the rest of a compound.
CONJUNCTIONS = frozenset("und u oder od bis bezw resp sowie noch wie als et ou e ed o and or a i nebo".split())
BREAK = regex.compile(rf"([\p{{L}}\p{{M}}\p{{N}}]+)([{regex.escape(MARKS)}])\s*$")
HEAD = regex.compile(r"^\s*([\p{L}\p{M}\p{N}]+)")
TOKEN = re.compile(r"[^\W\d_][^\W_]*|\d+[^\W\d_][^\W_]*")  # composed text; the standard module is much the faster one
NUMBER = re.compile(r"\d+")
EACH = re.compile(r"[^\W\d_][^\W_]*|\d+(?:[^\W\d_][^\W_]*)?")
COMPOUND = regex.compile(rf"([\p{{L}}\p{{M}}]+)-(?=([\p{{L}}\p{{M}}]+))")
LEFT_BREAK = regex.compile(rf"(?<=[\p{{L}}])[{regex.escape(MARKS)}]\s+(?!(?:{'|'.join(sorted(CONJUNCTIONS))})\b)(?=\p{{Ll}})")
MARKED = re.compile(rf"[{re.escape(MARKS)}]\s")
TITLED = regex.compile(r"^(?:(?:Nr|No)\.?\s*)?\p{N}+\.?\s{1,}(?P<a>\p{L}.*?)(?:\s+(?:vom|den|am)\s+[\p{N}.\s]+)?$|^(?P<b>\p{L}.*?)\s{2,}(?:\p{L}+\.?\s+)?\p{N}+\.?$")
MARGIN = 2.0  # a perceptron is updated until the right answer leads by this much


def plain(s: str) -> str:
    """Lower case, composed, long s as s."""
    s = s.lower().replace("ſ", "s")
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def unbroken(p: str) -> str:
    """A corrected text with the line-end hyphens that are left in it taken out."""
    return LEFT_BREAK.sub("", p) if any(m in p for m in MARKS) else p


NO_LETTERS = re.compile(r"[\W\d_]+")
PAGE_WORDS = re.compile(r"^(?:nr|no|seite|page|pag|strana)\s+|\s+(?:vom|seite|page|pag|strana|nr|no)$")
PAGE_FIRST = frozenset("nr no seite page pag strana".split())  # what PAGE_WORDS takes from the beginning and the end
PAGE_LAST = PAGE_FIRST | {"vom"}
SHAPE = re.compile(r"\d+|[^\W\d_]+|\s{2,}")


def letters(s: str) -> str:
    return NO_LETTERS.sub(" ", plain(s)).strip()


def broken(line: str):
    """The match of a word broken at the line's end, or None."""
    end = line.rstrip()
    return BREAK.search(end[end.rfind(" ") + 1 :]) if end and end[-1] in MARKS else None


def title_of(line: str) -> str | None:
    """The title beside a page or issue number, if the line looks like a running header."""
    if len(line) > 80 or not ("  " in line or "\t" in line or line.startswith(("Nr", "No"))) or not NUMBER.search(line):
        return None
    m = TITLED.match(line)
    t = m and letters(m["a"] or m["b"])
    return t if t and len(t) >= 5 and len(t.split()) <= 6 else None


def counts(ads: DataFrame, text: str, scan: str, source: str) -> DataFrame:
    """(kind, a, b, n): how often each word ('w'), hyphenated word ('h') and (source, title) ('t') occurs in all ads.

    Every task adds up its share before anything is shuffled, so a frequent word is one row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array([k[2] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["kind", "a", "b", "n"])
            held.clear()
            return out

        words: Counter = Counter()
        for b in batches:
            for t, s, src in zip(b.column("t").to_pylist(), b.column("s").to_pylist(), b.column("src").to_pylist(), strict=True):
                if t:
                    if MARKED.search(t):
                        t = unbroken(plain(t))
                    words.update(_named(_all_words(t)))
                    if "-" in t:
                        held.update(("h", h, "") for x in t.split() if "-" in x for h in HYPHENED[x] if h.rpartition("-")[2] not in CONJUNCTIONS)
                if s:
                    held.update(("t", src or "", u) for line in s.split("\n") if (u := title_of(line.strip())))
            if len(words) + len(held) > 200_000:
                held.update({("w", w, ""): n for w, n in words.items()})
                words.clear()
                yield flush()
        held.update({("w", w, ""): n for w, n in words.items()})
        if held:
            yield flush()

    src = ads.select(F.col(text).alias("t"), F.col(scan).alias("s"), F.col(source).alias("src"))
    return spread(src).mapInArrow(run, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


class Perceptron:
    """Averaged perceptron over string features; score > 0 means yes."""

    def __init__(self):
        self.w: dict[str, float] = defaultdict(float)
        self.sum: dict[str, float] = defaultdict(float)
        self.at = 0

    def score(self, fs: Iterable[str]) -> float:
        w = self.w
        return sum(w[f] for f in fs if f in w)

    def add(self, fs: Iterable[str], by: float) -> None:
        for f in fs:
            self.w[f] += by
            self.sum[f] += by * self.at

    def average(self) -> None:
        if self.at:
            self.w = {f: v - self.sum[f] / self.at for f, v in self.w.items() if abs(v - self.sum[f] / self.at) > 1e-9}


class Knowledge:
    """What the collection says: word and hyphenated-word counts, titles by source, the last words of titles."""

    def __init__(self, words: dict[str, int], hyphened: dict[str, int], titles: dict[str, set[str]]):
        self.words, self.hyphened, self.titles = words, hyphened, titles
        ends = Counter(t.split()[-1] for ts in titles.values() for t in ts)
        self.ends = frozenset(ends)
        self.sorted = sorted(words)
        self.longest = {s: max(map(len, ts)) for s, ts in titles.items() if ts}

    def title(self, source: str, line: str, words: list[str]) -> tuple[bool, bool]:
        """Whether a line is a title of the source, and whether a short line ends like one."""
        # A line with more letters than a title, two misread ones and the page words around it can have is none.
        longest = self.longest.get(source or "", 0)
        joined = "".join(words)
        if len(joined) > longest + 30 and (len(words) > 10 or not any(w in self.ends for w in words[-3:])):
            return False, False
        ws = words
        if not joined.isalpha():
            ws = _named(words)
            joined = "".join(ws)
        if joined.isalpha():  # no figures within words: the letters of the line are its words
            if len(ws) > 1 and ws[0] in PAGE_FIRST:
                ws = ws[1:]
            if len(ws) > 1 and ws[-1] in PAGE_LAST:
                ws = ws[:-1]
        else:
            ws = PAGE_WORDS.sub("", letters(line)).split()
        return len("".join(ws)) + len(ws) <= longest + 3 and _titled(" ".join(ws), self.titles.get(source or "", ())), bool(ws) and len(ws) <= 6 and ws[-1] in self.ends

    def begins(self, prefix: str) -> bool:
        """Whether a word of the lexicon begins so."""
        at = bisect_left(self.sorted, prefix)
        return at < len(self.sorted) and self.sorted[at].startswith(prefix)

    def bucket(self, w: str) -> int:
        return min(int(math.log2(self.words.get(w, 0) + 1)), 12)


def shape(line: str, parts: list[str]) -> str:
    """Figures as 9, capitalised words as A, words in capitals as X, other words as a, blanks as they are in number.

    `parts`: the line split at blanks. The first 24 symbols hold 12 blanks at most, so 13 parts are enough.
    """
    if " ".join(parts) != line:
        return SHAPE.sub(_symbol, line)[:24]
    return " ".join([SHAPES[x] for x in parts[:13]])[:24]


def _symbol(m: re.Match) -> str:
    w = m[0]
    c = w[0]
    if c.islower():
        return "a"
    if c.isalpha():
        return "X" if len(w) > 1 and w.isupper() else "A" if c.isupper() else "a"
    return "__" if c.isspace() else "9"


class Memo(dict):
    """What a function says of a string, computed once; cleared when it grows large."""

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, x: str):
        if len(self) > 300_000:
            self.clear()
        got = self[x] = self.f(x)
        return got

    def __reduce__(self):
        return Memo, (self.f,)


# Of what stands between blanks: words and figures, hyphenated words, shape; of a word: its letters as bits.
WORDS = Memo(lambda x: tuple(EACH.findall(plain(x))))
HYPHENED = Memo(lambda x: tuple(a + "-" + b for a, b in COMPOUND.findall(plain(x))))
SHAPES = Memo(lambda x: SHAPE.sub(_symbol, x))
LETTERS = Memo(lambda w: functools.reduce(lambda bits, c: bits | 1 << (ord(c) & 63), w, 0))


def _all_words(s: str) -> list[str]:
    """Words and figures, in order."""
    return list(itertools.chain.from_iterable(map(WORDS.__getitem__, s.split())))


def _named(words: list[str]) -> list[str]:
    """Words without figures."""
    return list(itertools.filterfalse(str.isdecimal, words))


class Witness:
    """What a corrected text that speaks of the same as the scan says about its lines."""

    def __init__(self, spoken: list[list[str]], said: list[str]):
        self.scanned = Counter(itertools.chain.from_iterable(spoken))
        self.wanted = Counter(said)
        scanned = self.scanned.get
        self.lacking = [(t, len(t)) for t, n in self.wanted.items() if n > scanned(t, 0) and len(t) >= 2]

    def needs(self, ws: list[str]) -> str:
        """'1' if the text needs a word of this line (it has it as often as the whole scan), 'f' if one like it, else '0'."""
        wanted, scanned = self.wanted.get, self.scanned.get
        for w in ws:
            if wanted(w, 0) >= scanned(w, 0):
                return "1"
        for w in ws if self.lacking else ():
            m = len(w)
            if m >= 4 and any(-2 <= n - m <= 2 and _similar(w, t) for t, n in self.lacking):
                return "f"
        return "0"


def line_key(lines: list[str], i: int, words: list[str], source: str, know: Knowledge, witness: Witness | None, breaks: list[bool]) -> tuple:
    """What the line model sees of a line. `words`: its words and figures; `witness`: None without a text that speaks of the same."""
    line = lines[i].strip()
    parts = line.split()
    where = "only" if len(lines) == 1 else "first" if i == 0 else "last" if i == len(lines) - 1 else "mid"
    seen = "none" if witness is None else witness.needs(words)
    return *know.title(source, line, words), where, seen, _carried(lines, i, breaks), shape(line, parts), min(len(parts), 7)


def line_features(key: tuple) -> list[str]:
    titled, ends, where, seen, carried, sh, n = key
    return ["b", f"t{titled}", f"e{ends}", f"p{where}", f"s{seen}", f"c{carried}", f"h{sh}", f"n{min(n, 6)}", f"t{titled}{where}", f"e{ends}{seen}", f"h{sh}{where}", f"s{seen}{carried}n{min(n, 4)}", f"h{sh}s{seen}", f"t{titled}{seen}{n <= 6}"]


def _titled(core: str, own: Iterable[str]) -> bool:
    """Whether a line's letters are a known title, or one misread in a place or two."""
    return bool(core) and (core in own or any(abs(len(t) - len(core)) <= 2 and _close(t, core) for t in own))


def _carried(lines: list[str], i: int, breaks: list[bool]) -> bool:
    """Whether the line may end a word broken on the line before it, or before a short line between. `breaks`: which are broken."""
    if i and breaks[i - 1]:
        return True
    return i > 1 and breaks[i - 2] and len(lines[i - 1]) < 60 and lines[i].strip()[:1].islower()


def _covered(spoken: list[list[str]], seen: set[str]) -> bool:
    """Whether the corrected text speaks of the same as the scan: it holds most of the words of its lines."""
    tokens = list(itertools.filterfalse(str.isdigit, itertools.chain.from_iterable(spoken)))
    return sum(map(seen.__contains__, tokens)) >= 0.75 * len(tokens)


def _lacking(wanted: Counter, own: Counter) -> list[str]:
    """Words that the corrected text has more often than the scan."""
    had = own.get
    return [t for t, n in wanted.items() if n > had(t, 0) and not t.isdigit()]


def _close(a: str, b: str) -> bool:
    """Whether two strings of similar length differ in at most two places (substitutions by position, or one shift)."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 2
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    return max(len(a), len(b)) - p - q <= 3


def join_features(left: str, mark: str, right: str, know: Knowledge, witness: set[str] | None, compounds: set[str] | None) -> list[str]:
    lo, ro = plain(left), plain(right)
    joined, hyph = lo + ro, lo + "-" + ro
    case = "U" if right[0].isupper() and not (left.isupper() and len(left) > 1 and right.isupper()) else "D" if right[0].isdigit() else "l"
    j, h = know.bucket(joined), min(int(math.log2(know.hyphened.get(hyph, 0) + 1)), 12)
    w = "none" if witness is None else f"{joined in witness}{hyph in (compounds or ())}"
    conj = ro in CONJUNCTIONS
    rel = "0" if not j and not h else "j" if j > h else "h" if h > j else "="
    return ["b", "m" + mark, "c" + case, f"k{conj}", f"r{rel}", f"w{w}", f"c{case}k{conj}", f"c{case}r{rel}", f"w{w}c{case}", f"j{min(j, 4)}", f"h{min(h, 4)}", f"l{min(len(lo), 4)}"]


def operations(a: str, b: str) -> list[tuple[str, str, str]]:
    """Edit operations that turn a into b: (left neighbour, letters of a, letters of b); neighbouring edits are one."""
    n, m = len(a), len(b)
    p = 0
    while p < min(n, m) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(n, m) - p and a[n - 1 - q] == b[m - 1 - q]:
        q += 1
    x, y = a[p : n - q], b[p : m - q]
    left = a[p - 1] if p else "^"
    if len(x) <= 2 and len(y) <= 2:
        return [(left, x, y)] if x or y else []
    d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if not i or not j:
                d[i][j] = i + j
            else:
                d[i][j] = min(d[i - 1][j - 1] + (x[i - 1] != y[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    ops: list[list[str]] = []
    i, j, run = len(x), len(y), None
    while i or j:
        if i and j and x[i - 1] == y[j - 1] and d[i][j] == d[i - 1][j - 1]:
            i, j, run = i - 1, j - 1, None
            continue
        if run is None:
            run = ["", "", ""]
            ops.append(run)
        if i and j and d[i][j] == d[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            run[1], run[2] = x[i] + run[1], y[j] + run[2]
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            run[1] = x[i] + run[1]
        else:
            j -= 1
            run[2] = y[j] + run[2]
        run[0] = x[i - 1] if i else left
    return [tuple(o) for o in reversed(ops)]


class Editor:
    """Edits a word letter by letter: at each letter the operations keep, replace, delete and insert are open, as learned.

    A sequence of operations is scored by its operations in their context and by what it leads to: a word that the corrected text
    lacks, or one of the lexicon. The best sequence wins, keeping every letter being one of them.
    """

    MOST = 2  # edits in a word that no witness vouches for

    def __init__(self, know: Knowledge):
        self.know, self.model = know, Perceptron()
        self.at: dict[str, list[tuple[str, str]]] = {}  # letter -> (letters from there, what replaces them)
        self.after: dict[str, list[str]] = {}  # left neighbour -> what may be inserted behind it
        self.memo: dict[str, list[str]] = {}
        self.alone: dict[tuple[str, str], tuple[float, str]] = {}
        self.vouched: dict[tuple[str, str, str], float] = {}

    def learn(self, seen: Counter, least: int = 3) -> None:
        """Take up the operations (left neighbour, from, to) that occurred `least` times; replacements count over all neighbours."""
        plainly: Counter = Counter()
        for (left, x, y), n in seen.items():
            if x:
                plainly[x, y] += n
            elif n >= least:
                self.after.setdefault(left, []).append(y)
        for (x, y), n in plainly.items():
            if n >= least:
                self.at.setdefault(x[0], []).append((x, y))

    def features(self, o: str, c: str, vouched: bool, present: str) -> list[str]:
        """present: 'none' without a witness, 'yes' if it holds the scanned word too, else 'no'."""
        kc, ko = self.know.bucket(c), self.know.bucket(o)
        if o == c:
            return ["keep", "keep" + present, f"keepf{min(ko, 5)}", f"keep{present}f{min(ko, 5)}", f"keep{any(x.isdigit() for x in o)}"]
        ops = operations(o, c)
        fs = [f"n{min(len(ops), 3)}", f"v{vouched}{present}", f"f{min(kc, 5)}", f"d{max(-3, min(6, kc - ko))}", f"v{vouched}{present}d{max(-2, min(4, kc - ko))}", f"v{vouched}{present}o{min(ko, 5)}", f"z{min(4, sum(max(len(x), len(y)) for _, x, y in ops))}v{vouched}"]
        for left, x, y in ops:
            fs += [f"o{x}>{y}", f"o{left}|{x}>{y}"] if len(x) <= 3 and len(y) <= 3 else ["olong", "olong" + str(max(len(x), len(y)) - len(min(x, y, key=len)) > 2)]
        return fs

    def reach(self, o: str) -> list[str]:
        """All lexicon words that up to MOST learned operations lead to, found letter by letter along the lexicon's beginnings."""
        got = self.memo.get(o)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            know, n = self.know, len(o)
            out = set()
            stack = [(0, "", 0)]
            while stack:
                i, made, k = stack.pop()
                if i == n and k and know.words.get(made, 0) >= 3:
                    out.add(made)
                if i < n and know.begins(made + o[i]):
                    stack.append((i + 1, made + o[i], k))
                if k < self.MOST:
                    for x, y in self.at.get(o[i], ()) if i < n else ():
                        if o.startswith(x, i) and know.begins(made + y):
                            stack.append((i + len(x), made + y, k + 1))
                    for y in self.after.get(o[i - 1] if i else "^", ()):
                        if know.begins(made + y):
                            stack.append((i, made + y, k + 1))
            got = self.memo[o] = sorted(out - {o})
        return got

    def near(self, o: str, lacking: list[str]) -> list[str]:
        lo, hi = len(o) - 2, len(o) + 2
        return [t for t in lacking if lo <= len(t) <= hi and _similar(o, t)]

    def candidates(self, o: str, lacking: list[str]) -> list[tuple[str, bool]]:
        """(word, vouched for by the witness)."""
        near = self.near(o, lacking)
        return [(t, True) for t in near] + [(w, False) for w in self.reach(o) if w not in near]

    def best(self, o: str, lacking: list[str], present: str) -> str:
        near = self.near(o, lacking) if lacking else ()
        got = self.alone.get((o, present))
        if got is None:  # what the word may be by lexicon and operations is the same on all pages
            if len(self.alone) > 400_000:
                self.alone.clear()
            got = self.model.score(self.features(o, o, False, present)), o
            for c in self.reach(o):
                s = self.model.score(self.features(o, c, False, present))
                if s > got[0]:
                    got = s, c
            self.alone[o, present] = got
        if not near:
            return got[1]
        top, word = got
        if len(self.vouched) > 400_000:
            self.vouched.clear()
        for c in near:
            s = self.vouched.get((o, c, present))
            if s is None:
                s = self.vouched[o, c, present] = self.model.score(self.features(o, c, True, present))
            if s > top:
                top, word = s, c
        return word


PAIRS: dict[tuple[str, str], bool] = {}


def _similar(a: str, b: str) -> bool:
    """At least half of the longer word's letters in common, in a cheap count; seven tenths unless they begin or end alike."""
    longer = max(len(a), len(b))
    most = len(b) - (LETTERS[b] & ~LETTERS[a]).bit_count()  # letters in common, as many at most
    if most < 0.7 * longer and (most < 0.5 * longer or a[:2] != b[:2] and a[-2:] != b[-2:]):
        return False
    got = PAIRS.get((a, b))
    if got is None:
        if len(PAIRS) > 300_000:
            PAIRS.clear()
        common = 0
        for x in set(b):
            n = a.count(x)
            if n:
                common += 1 if n == 1 else min(n, b.count(x))
        got = PAIRS[a, b] = a != b and common >= 0.5 * longer and (common >= 0.7 * longer or a[:2] == b[:2] or a[-2:] == b[-2:])
    return got


class Page:
    """The three models together."""

    def __init__(self, know: Knowledge):
        self.know, self.lines, self.joins, self.editor = know, Perceptron(), Perceptron(), Editor(know)
        self.judged: dict[tuple, bool] = {}
        self.judged_by: dict | None = None

    def witness(self, text: str | None) -> tuple[list[str], set[str] | None, set[str] | None]:
        """Words and figures of a corrected text, the same as a set, and its hyphenated words."""
        if not text:
            return [], None, None
        if MARKED.search(text):
            text = unbroken(plain(text))
        said = _all_words(text)
        return said, set(said), {h for x in text.split() if "-" in x for h in HYPHENED[x]} if "-" in text else set()

    def furniture(self, key: tuple) -> bool:
        if len(self.judged) > 400_000 or self.judged_by is not self.lines.w:
            self.judged, self.judged_by = {}, self.lines.w
        got = self.judged.get(key)
        if got is None:
            got = self.judged[key] = self.lines.score(line_features(key)) > 0
        return got

    def repair(self, scan: str | None, text: str | None, source: str | None) -> tuple[str, list[tuple[str, str]]]:
        """Continuous text of a scan, and what was repaired as (kind, item), each once."""
        if not scan:
            return "", []
        said, seen, compounds = self.witness(text)
        know = self.know
        found: dict[tuple[str, str], None] = {}
        kept: list[str] = []
        at: list[int] = []  # which lines are kept
        lines = [x for x in scan.split("\n") if x.strip()]
        spoken = [_all_words(x) for x in lines]
        breaks = [x.rstrip()[-1] in MARKS and bool(broken(x)) for x in lines]
        witness = Witness(spoken, said) if seen is not None and _covered(spoken, seen) else None
        for i, line in enumerate(lines):
            if self.furniture(line_key(lines, i, spoken[i], source, know, witness, breaks)):
                found["furniture", line.strip()] = None
            else:
                kept.append(line)
                at.append(i)
        pieces: list[str] = []
        tokens: list[str] = []
        splits: list[str] = []
        carry = ""
        for i, line in enumerate(kept):
            carried = carry
            line = carry + line.strip()
            carry = ""
            m = broken(line) if carried or breaks[at[i]] else None
            nxt = HEAD.match(kept[i + 1]) if m and i + 1 < len(kept) else None
            if m and nxt:
                if self.joins.score(join_features(m[1], m[2], nxt[1], know, seen, compounds)) > 0:
                    carry = line.rstrip()[:-1]
                    splits.append(plain(m[1] + nxt[1]))
                    continue
                carry = line.rstrip()[:-1] + ("- " if plain(nxt[1]) in CONJUNCTIONS else "-")
                continue
            pieces.append(line)
            tokens += TOKEN.findall(plain(line)) if carried else _named(spoken[at[i]])
        if carry:
            pieces.append(carry)
            tokens += TOKEN.findall(plain(carry))
        whole = " ".join(pieces)
        own = Counter(tokens)
        lacking = _lacking(witness.wanted if witness else Counter(said), own)
        by_length: dict[int, list[str]] = {}  # the lacking words that one of this length may be
        fixed: dict[str, str] = {}
        best, alone = self.editor.best, self.editor.alone.get
        for w in own:
            if len(w) < 2:
                continue
            present = "none" if seen is None else "yes" if w in seen else "no"
            n = len(w)
            near = by_length.get(n)
            if near is None:
                near = by_length[n] = [t for t in lacking if -2 <= len(t) - n <= 2]
            got = None if near else alone((w, present))
            c = best(w, near, present) if got is None else got[1]
            if c != w:
                fixed[w] = c
                found["misread", c] = None
        for s in splits:
            found["split", fixed.get(s, s)] = None
        if fixed:
            whole = TOKEN.sub(lambda m: _cased(m[0], fixed[p]) if (p := plain(m[0])) in fixed else m[0], whole)
        return whole, list(found)


def _cased(was: str, now: str) -> str:
    return now.upper() if was.isupper() and len(was) > 1 else now[0].upper() + now[1:] if was[0].isupper() else now


def train(sample: list[tuple[str, str, str]], know: Knowledge, epochs: int = 4, seed: int = 11) -> Page:
    """Fit the three models on (scan, corrected text, source); repeatable for the same sample in any order."""
    page = Page(know)
    rng = random.Random(seed)
    sample = sorted(sample)
    lines_data, join_data, word_data = [], [], []
    moves: Counter = Counter()
    for n, (scan, text, source) in enumerate(sample):
        said, seen, compounds = page.witness(text)
        hide = n % 3 == 0
        lines = [x for x in scan.split("\n") if x.strip()]
        spoken = [_all_words(x) for x in lines]
        breaks = [x.rstrip()[-1] in MARKS and bool(broken(x)) for x in lines]
        kept = []
        if not _covered(spoken, seen):
            continue  # the text is cut, invented or another one: it teaches nothing about this scan
        both = Witness(spoken, said)
        for i, line in enumerate(lines):
            carried = _carried(lines, i, breaks)
            # Nothing of a line in the corrected text: furniture, unless it only ends a broken word.
            gone = both.needs(spoken[i]) == "0" and not (carried and line.strip()[:1].islower()) and len(lines) > 1
            lines_data.append((line_features(line_key(lines, i, spoken[i], source, know, None if hide else both, breaks)), gone))
            if not gone:
                kept.append(line)
        carry = ""
        pieces = []
        for i, line in enumerate(kept):
            line = carry + line.strip()
            carry = ""
            m = broken(line)
            nxt = HEAD.match(kept[i + 1]) if m and i + 1 < len(kept) else None
            if m and nxt:
                joined, hyph = plain(m[1] + nxt[1]), plain(m[1]) + "-" + plain(nxt[1])
                yes = joined in seen
                if yes or hyph in compounds or plain(nxt[1]) in CONJUNCTIONS:
                    yes = yes and not (hyph in compounds or plain(nxt[1]) in CONJUNCTIONS)
                    join_data.append((join_features(m[1], m[2], nxt[1], know, None if hide else seen, None if hide else compounds), yes))
                else:
                    yes = nxt[1][0].islower()
                carry = line.rstrip()[:-1] + ("" if yes else "-")
                continue
            pieces.append(line)
        tokens = TOKEN.findall(plain(" ".join(pieces)))
        own = Counter(tokens)
        lacking = _lacking(both.wanted, own)
        for w in own:
            if len(w) < 2:
                continue
            if w not in seen:
                near = [t for t in lacking if abs(len(t) - len(w)) <= 2 and _similar(w, t)]
                gold = min(near, key=lambda t: (sum(max(len(x), len(y)) for _, x, y in operations(w, t)), t), default=w)
                ops = operations(w, gold)
                if sum(max(len(x), len(y)) for _, x, y in ops) > max(2, 0.4 * len(w)):
                    gold = w
                else:
                    moves.update(ops)
                word_data.append((w, lacking, gold, "none" if hide else "no"))
            elif know.words.get(w, 0) < 3 or rng.random() < 0.02:
                word_data.append((w, lacking, w, "none" if hide else "yes"))
    page.editor.learn(moves)
    for data, model in ((lines_data, page.lines), (join_data, page.joins)):
        for _ in range(epochs):
            rng.shuffle(data)
            for fs, yes in data:
                model.at += 1
                if model.score(fs) * (1 if yes else -1) < MARGIN:
                    model.add(fs, 1.0 if yes else -1.0)
        model.average()
    ed = page.editor
    made = []
    for w, lacking, gold, present in word_data:
        cands = ed.candidates(w, [] if present == "none" else lacking)
        opts = [(w, ed.features(w, w, False, present))] + [(c, ed.features(w, c, v, present)) for c, v in cands]
        if any(c == gold for c, _ in opts):
            made.append((opts, gold))
    for _ in range(epochs):
        rng.shuffle(made)
        for opts, gold in made:
            ed.model.at += 1
            right = next(fs for c, fs in opts if c == gold)
            rivals = [(ed.model.score(fs), c, fs) for c, fs in opts if c != gold]
            top = max(rivals, default=None)
            if top and top[0] + MARGIN > ed.model.score(right):
                ed.model.add(right, 1.0)
                ed.model.add(top[2], -1.0)
    ed.model.average()
    return page


def learn(ads: DataFrame, key: str, text: str, scan: str, source: str, sample_rows: int, lexicon: int) -> Page:
    """Counts over all ads, then the models on a sample of about `sample_rows` whole ads of smallest hash.

    The lexicon that is sent to the tasks is bounded: the `lexicon` most frequent words of at least three occurrences.
    Misread titles and chance matches are far rarer than a source's own titles: those of at least a tenth of the most frequent
    one hold, which Spark decides before any reaches the driver.
    """
    c = cut(counts(ads, text, scan, source))
    frequent = c.where("kind = 'w' and n >= 3").orderBy(F.desc("n"), "a").limit(lexicon).select("a", "n").collect()
    hyphened = c.where("kind = 'h' and n >= 2").orderBy(F.desc("n"), "a").limit(lexicon).select("a", "n").collect()
    t = c.where("kind = 't' and n >= 2")
    own = t.join(t.groupBy("a").agg(F.max("n").alias("most")), "a").where("n >= 0.1 * most").select("a", "b")
    titles: dict[str, set[str]] = defaultdict(set)
    for r in bounded_rows(own, 1_000_000, "the list of the sources' own titles"):
        titles[r["a"]].add(r["b"])
    know = Knowledge({r["a"]: r["n"] for r in frequent}, {r["a"]: r["n"] for r in hyphened}, dict(titles))
    usable = ads.where(F.col(text).isNotNull() & F.col(scan).isNotNull() & F.col(key).isNotNull())
    share = min(1.0, sample_rows / max(usable.count(), 1))
    got = usable.where(hash_below(key, share)).select(F.col(scan).alias("s"), F.col(text).alias("t"), F.coalesce(F.col(source), F.lit("")).alias("o"))
    rows = bounded_rows(got, 3 * sample_rows + 1000, "the training sample")
    return train([(r["s"], r["t"], r["o"]) for r in rows], know)


def repair(ads: DataFrame, key: str = "ad_id", text: str = "text", scan: str = "text_ocr", source: str = "newspaper", sample_rows: int = 4000, lexicon: int = 1_000_000) -> DataFrame:
    """(key, repaired, items): the continuous text of every scan and the repairs, an array of (kind, item).

    One Arrow pass over all rows and whole texts. NULL and empty scans give an empty text without items; a NULL corrected text
    leaves the scan without a second witness. Rows delivered twice are repaired twice, alike; `found` counts them once.
    Without any usable row the models are empty and change nothing. Extra columns are ignored; an empty table gives no rows.
    """
    shared = Shared(ads.sparkSession, learn(ads, key, text, scan, source, sample_rows, lexicon))
    src = ads.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(scan).alias("s"), F.col(source).cast("string").alias("o"))
    key_kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: Page = shared.value
        for b in batches:
            texts, kinds, items, ends = [], [], [], [0]
            for t, s, o in zip(b.column("t").to_pylist(), b.column("s").to_pylist(), b.column("o").to_pylist(), strict=True):
                whole, found = page.repair(s, t, o)
                texts.append(whole)
                for x, y in found:
                    kinds.append(x)
                    items.append(y)
                ends.append(len(items))
            each = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(items, pa.string())], names=["kind", "item"])
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["k", "repaired", "items"])

    return spread(src).mapInArrow(run, f"k {key_kind}, repaired string, items array<struct<kind:string,item:string>>").withColumnRenamed("k", key)


def found(repaired: DataFrame, key: str = "ad_id") -> DataFrame:
    """(key, kind, item), each once."""
    return repaired.where(F.col(key).isNotNull()).select(key, F.explode("items").alias("x")).select(key, "x.kind", "x.item").distinct()
