"""Language of every document and of every stretch in another language (problem 2).

A linear-chain conditional random field labels the words of a text. A word's features are its form, its affixes, its letter
n-grams and its entry in a lexicon of words that belong to one language, drawn from the sample; transitions are learned separately for neighbours inside a sentence and across a sentence
end. Forward-backward gives every word a distribution over languages; a sentence takes the language of largest summed
probability, neighbouring sentences of one language form a stretch, and a stretch's confidence is its words' mean
probability.

The field is fitted on the driver on a bounded sample of labelled rows (`per_language` rows of each label, chosen by hash).
Labels of the sample are only believed after a naive Bayes pass over its sentences, since some are wrong and some texts are
mixed; mixed sequences are then composed from sentences of known language. Decoding covers every row and whole texts, in one
Arrow pass without a shuffle of texts.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.runtime import Shared, bounded_rows, hash_below, spread

LANGUAGES = ("de", "fr", "it", "en", "cs")
# Notations of the languages (two- and three-letter codes and names); a region or script may follow.
NOTATIONS = {
    "de": ("de", "deu", "ger", "german", "deutsch", "dt"), "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch"),
    "it": ("it", "ita", "italian", "italiano", "italienisch"), "en": ("en", "eng", "english", "englisch"),
    "cs": ("cs", "cz", "ces", "cze", "czech", "čeština", "tschechisch", "böhmisch"),
}
CODE_OF = {n: c for c, ns in NOTATIONS.items() for n in ns}
TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?|[.!?]+(?=\s|$)|\n+|\p{N}+")
WORD = regex.compile(r"[\p{L}\p{N}]+")
LEAST_WORDS = 6
K = len(LANGUAGES)


ROMAN = regex.compile(r"[ivxlc]+$")
# The one-letter words of the five languages, which may begin a sentence.
LONE = set("AEIOUVKSZYÀÈ")


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """Words in lower case with long s as s, and for each whether a sentence ended before it.

    A stop ends a sentence if a capitalised word follows that is no lone consonant as in "fl. öst. W.", and no Roman number
    stands before it, so that abbreviations stay inside; in texts without capitals every stop ends one.
    """
    words, first, stop = [], [], True
    text = text.replace("ſ", "s")
    cased = any(c.isupper() for c in text)
    for t in TOKEN.findall(text):
        if t[0].isalpha():
            low = t.lower()
            begins = not words or (stop and (not cased or (t[0].isupper() and (len(t) > 1 or t in LONE) and not (ROMAN.match(words[-1]) and len(words[-1]) < 5))))
            words.append(low)
            first.append(begins)
            stop = False
        elif t[0] in ".!?":
            stop = True
    return words, first


def features(word: str, lexicon: dict[str, int] | None = None) -> list[str]:
    p = f"^{word}$"
    out = ["w=" + word]
    if lexicon and word in lexicon:
        out.append(f"lex={LANGUAGES[lexicon[word]]}")
    out += ["p" + p[:n] for n in (2, 3, 4) if n < len(p)]
    out += ["s" + p[-n:] for n in (2, 3, 4, 5) if n < len(p)]
    out += ["g" + p[i : i + 3] for i in range(len(p) - 2)]
    return out


class Field:
    """A fitted field: feature weights and transitions (inside a sentence, across its end)."""

    def __init__(self, weights: dict[str, np.ndarray], inside: np.ndarray, across: np.ndarray, start: np.ndarray, lexicon: dict[str, int]):
        self.weights, self.inside, self.across, self.start, self.lexicon = weights, inside, across, start, lexicon
        self.cache: dict[str, np.ndarray] = {}

    def emission(self, word: str) -> np.ndarray:
        e = self.cache.get(word)
        if e is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            e = np.zeros(K)
            for f in features(word, self.lexicon):
                w = self.weights.get(f)
                if w is not None:
                    e = e + w
            self.cache[word] = e
        return e

    def marginals(self, seqs: list[list[str]], firsts: list[list[bool]]) -> list[np.ndarray]:
        """Word by language probabilities of every sequence, by forward-backward, in blocks of similar length."""
        out: list[np.ndarray] = [np.zeros((0, K))] * len(seqs)
        order = sorted((i for i in range(len(seqs)) if seqs[i]), key=lambda i: len(seqs[i]))
        at = 0
        while at < len(order):
            longest = len(seqs[order[min(at + 511, len(order) - 1)]])
            block = order[at : at + (512 if longest < 2000 else 1)]
            at += len(block)
            length = np.array([len(seqs[i]) for i in block])
            e = np.zeros((len(block), int(length.max()), K))
            b = np.zeros(e.shape[:2], bool)
            for r, i in enumerate(block):
                e[r, : length[r]] = [self.emission(w) for w in seqs[i]]
                b[r, : length[r]] = firsts[i]
            m, _, _ = forward_backward(e, b, length, self.inside, self.across, self.start)
            for r, i in enumerate(block):
                out[i] = m[r, : length[r]]
        return out


def forward_backward(e: np.ndarray, b: np.ndarray, length: np.ndarray, inside: np.ndarray, across: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals [n, t, K], log likelihood terms and, if asked for, summed pair marginals (inside, across)."""
    n, t_max, _ = e.shape
    ex = np.exp(e - e.max(2, keepdims=True))
    tin, tac = np.exp(inside), np.exp(across)
    alpha = np.zeros_like(ex)
    scale = np.ones((n, t_max))
    a = ex[:, 0] * np.exp(start)
    scale[:, 0] = a.sum(1)
    alpha[:, 0] = a / scale[:, :1]
    for t in range(1, t_max):
        prev = alpha[:, t - 1]
        a = np.where(b[:, t, None], prev @ tac, prev @ tin) * ex[:, t]
        s = a.sum(1)
        live = t < length
        scale[:, t] = np.where(live, s, 1)
        alpha[:, t] = np.where(live[:, None], a / np.maximum(s, 1e-300)[:, None], prev)
    beta = np.ones((n, K))
    m = np.zeros_like(ex)
    xin, xac = np.zeros((K, K)), np.zeros((K, K))
    for t in range(t_max - 1, -1, -1):
        live = t < length
        m[:, t] = alpha[:, t] * beta * live[:, None]
        if t:
            v = ex[:, t] * beta / scale[:, t, None]
            back = np.where(b[:, t, None], v @ tac.T, v @ tin.T)
            if pairs:
                for mask, tr, x in ((live & ~b[:, t], tin, xin), (live & b[:, t], tac, xac)):
                    if mask.any():
                        x += tr * (alpha[mask, t - 1].T @ v[mask])
            beta = np.where(live[:, None], back, beta)
    return m / np.maximum(m.sum(2, keepdims=True), 1e-300), xin, xac


def believe(texts: list[tuple[str, str]], rounds: int = 3, stay: float = 4.0) -> list[list[tuple[list[str], int]]]:
    """Per text its sentences with a language each: naive Bayes over features, started from the texts' labels.

    A sentence is `stay` (a logarithm of odds) likelier in the language of the whole text than in another one.
    """
    docs: list[list[tuple[list[str], int]]] = []
    for text, code in texts:
        words, first = tokens(text)
        cuts = [i for i, x in enumerate(first) if x] + [len(words)]
        docs.append([(words[i:j], LANGUAGES.index(code)) for i, j in zip(cuts, cuts[1:], strict=False) if j > i])
    feats = {w: features(w) for d in docs for s, _ in d for w in s}
    for _ in range(rounds):
        counts = [Counter() for _ in range(K)]
        for d in docs:
            for s, c in d:
                for w in s:
                    counts[c].update(feats[w])
        total = [sum(c.values()) + 1e4 for c in counts]
        memo = {w: sum((np.log([(counts[k][f] + 0.1) / total[k] for k in range(K)]) for f in fs), np.zeros(K)) / len(fs) for w, fs in feats.items()}
        new = []
        for d in docs:
            of = [sum((memo[w] for w in s), np.zeros(K)) for s, _ in d]
            whole = int(sum(of, np.zeros(K)).argmax())
            own = stay * (np.arange(K) == whole)
            # Short sentences ("Lohn 71 fl.") take the language of the sentence before them, at the start that of the text.
            row: list[tuple[list[str], int]] = []
            for (s, _), lp in zip(d, of, strict=True):
                row.append((s, int((lp + own).argmax()) if len(s) >= 5 else row[-1][1] if row else whole))
            new.append(row)
        if new == docs:
            break
        docs = new
    return docs


def lexicon_of(docs: list[list[tuple[list[str], int]]], least: int = 3, purity: float = 0.9) -> dict[str, int]:
    """Words that stand at least `least` times in sentences of one language, and hardly in those of another."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for d in docs:
        for s, c in d:
            for w in s:
                seen[w][c] += 1
    out = {}
    for w, n in seen.items():
        c, most = max(n.items(), key=lambda x: (x[1], -x[0]))
        if most >= least and most >= purity * n.total():
            out[w] = c
    return out


def compose(docs: list[list[tuple[list[str], int]]], n: int, rng: np.random.Generator) -> list[tuple[list[str], list[bool], list[int]]]:
    """Training sequences from stretches of successive sentences of one text and language: half of them mixed."""
    by: dict[int, list[list[list[str]]]] = defaultdict(list)
    for d in docs:
        for c, group in itertools.groupby(d, key=lambda x: x[1]):
            by[c].append([s for s, _ in group])
    have = [c for c in sorted(by) if by[c]]
    out = []
    for i in range(n if have else 0):
        words, first, labels = [], [], []
        last = -1
        for _ in range(1 if i % 2 else int(rng.integers(2, 5))):
            c = have[int(rng.integers(len(have)))]
            if c == last and len(have) > 1:
                continue
            last = c
            run = by[c][int(rng.integers(len(by[c])))]
            at = int(rng.integers(len(run)))
            for s in run[at : at + int(rng.integers(1, 5))]:
                words += s
                first += [True] + [False] * (len(s) - 1)
                labels += [c] * len(s)
        if words:
            out.append((words, first, labels))
    return out


def fit(texts: list[tuple[str, str]], sequences: int = 4000, epochs: int = 4, rate: float = 0.08, l2: float = 1e-5, seed: int = 7) -> Field:
    """Maximise the conditional likelihood of composed sequences with Adam; repeatable for the same texts in any order."""
    rng = np.random.default_rng(seed)
    believed = believe(sorted(texts))
    lexicon = lexicon_of(believed)
    data = compose(believed, sequences, rng)
    vocab: dict[str, int] = {}
    ids: dict[str, int] = {}
    rows: list[int] = []
    cols: list[int] = []
    for words, _, _ in data:
        for w in words:
            if w not in vocab:
                vocab[w] = len(vocab)
                for f in features(w, lexicon):
                    rows.append(vocab[w])
                    cols.append(ids.setdefault(f, len(ids)))
    r, c = np.array(rows, np.int64), np.array(cols, np.int64)
    params = {"w": np.zeros((max(len(ids), 1), K)), "in": np.eye(K) * 2.0, "ac": np.eye(K) * 0.5, "st": np.zeros(K)}
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    data.sort(key=lambda x: len(x[0]))
    blocks = [data[i : i + 200] for i in range(0, len(data), 200)]
    packed = []
    for blk in blocks:
        length = np.array([len(x[0]) for x in blk])
        t = int(length.max())
        wid, b, y = np.zeros((len(blk), t), np.int64), np.zeros((len(blk), t), bool), np.full((len(blk), t), -1)
        for i, (words, first, labels) in enumerate(blk):
            wid[i, : len(words)] = [vocab[w] for w in words]
            b[i, : len(words)] = first
            y[i, : len(words)] = labels
        packed.append((wid, b, y, length))
    for _ in range(epochs):
        for at in rng.permutation(len(packed)):
            wid, b, y, length = packed[at]
            types = np.zeros((len(vocab), K))
            for k in range(K):
                types[:, k] = np.bincount(r, params["w"][c, k], len(vocab))
            mask = y >= 0
            m, xin, xac = forward_backward(types[wid], b, length, params["in"], params["ac"], params["st"], pairs=True)
            gold = np.zeros_like(m)
            np.put_along_axis(gold, np.maximum(y, 0)[..., None], 1.0, 2)
            diff = (gold - m) * mask[..., None]
            gt = np.zeros((len(vocab), K))
            for k in range(K):
                gt[:, k] = np.bincount(wid.ravel(), diff[..., k].ravel(), len(vocab))
            g = {"w": np.zeros_like(params["w"])}
            for k in range(K):
                g["w"][:, k] = np.bincount(c, gt[r, k], params["w"].shape[0])
            gin, gac = -xin, -xac
            nxt, prv = y[:, 1:], y[:, :-1]
            both = nxt >= 0
            np.add.at(gin, (prv[both & ~b[:, 1:]], nxt[both & ~b[:, 1:]]), 1.0)
            np.add.at(gac, (prv[both & b[:, 1:]], nxt[both & b[:, 1:]]), 1.0)
            g |= {"in": gin, "ac": gac, "st": gold[:, 0].sum(0) - m[:, 0].sum(0)}
            step += 1
            for k, v in params.items():
                d = g[k] / len(wid) - l2 * v
                m1, m2 = mom[k]
                m1 *= 0.9
                m1 += 0.1 * d
                m2 *= 0.999
                m2 += 0.001 * d * d
                v += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    weights = {f: params["w"][i] for f, i in ids.items()}
    return Field(weights, params["in"], params["ac"], params["st"], lexicon)


def code(lang):
    """The language a label column names, in any known notation; NULL for none, an unknown or undetermined one."""
    table = F.create_map(*[x for n, c in CODE_OF.items() for x in (F.lit(n), F.lit(c))])
    return F.try_element_at(table, F.regexp_extract(F.lower(F.trim(lang)), r"^(\p{L}+)", 1))


def sample(docs: DataFrame, text: str, lang: str, key: str, per_language: int) -> list[tuple[str, str]]:
    """About `per_language` whole labelled texts of each language, those of smallest hash: the only rows that reach the driver."""
    labelled = docs.select(F.col(text).alias("t"), code(F.col(lang)).alias("c"), F.col(key).alias("k")).where("c is not null and length(t) >= 40")
    sizes = {r["c"]: r["n"] for r in labelled.groupBy("c").agg(F.count("*").alias("n")).collect()}  # five rows at most
    keep = F.lit(False)
    for c, n in sizes.items():
        keep = keep | ((F.col("c") == c) & hash_below("k", min(1.0, per_language / n)))
    got = bounded_rows(labelled.where(keep).select("t", "c"), 4 * per_language * K + 1000, "the training sample")
    return [(r["t"], r["c"]) for r in got]


SEGMENTS = "array<struct<lang:string,confidence:double,n_words:int>>"


def _decoder(shared):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                texts = [t or "" for t in b.column("t").to_pylist()]
                toks = [tokens(t) for t in texts]
                segs = [segments(m, f) for m, (_, f) in zip(field.marginals([w for w, _ in toks], [f for _, f in toks]), toks, strict=True)]
                n = [sum(1 for _ in WORD.finditer(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("c"), pa.array(n, pa.int32()), pa.array(segs, kind)], names=["k", "c", "n_words", "segments"])

    return run


def segments(m: np.ndarray, first: list[bool]) -> list[dict]:
    """Maximal stretches of sentences in one language, in text order, with confidence and number of words."""
    out: list[list] = []
    cuts = [i for i, x in enumerate(first) if x] + [len(first)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            s = m[i:j].sum(0)
            k = int(s.argmax())
            if out and out[-1][0] == k:
                out[-1][1] += m[i:j, k].sum()
                out[-1][2] += j - i
            else:
                out.append([k, m[i:j, k].sum(), j - i])
    return [{"lang": LANGUAGES[k], "confidence": float(p / n), "n_words": int(n)} for k, p, n in out]


def languages(docs: DataFrame, key: str = "ad_id", text: str = "text_norm", lang: str = "lang", per_language: int = 500) -> DataFrame:
    """One row per document: key, label_code (what its label means), n_words, segments (language, confidence, words of each stretch).

    Documents delivered twice count once; where deliveries differ, the larger segments in array order hold. NULL, empty and
    wordless texts have no segments. Very long texts are decoded whole. Extra columns are ignored. Without any labelled row
    the field has no weights and every word is equally likely in all languages (ties go to the first language of the list).
    """
    field = fit(sample(docs, text, lang, key, per_language))
    shared = Shared(docs.sparkSession, field)
    src = docs.select(F.col(key).alias("k"), code(F.col(lang)).alias("c"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    out = spread(src).mapInArrow(_decoder(shared), f"k {kind}, c string, n_words int, segments {SEGMENTS}")
    one = out.groupBy("k").agg(F.max(F.struct("segments", "c", "n_words")).alias("x"))
    return one.select(F.col("k").alias(key), F.col("x.c").alias("label_code"), F.col("x.n_words").alias("n_words"), F.col("x.segments").alias("segments"))


def found(labelled: DataFrame, key: str = "ad_id") -> DataFrame:
    """(key, seg_no, lang): texts of one language whose label does not name it, and every stretch of the mixed ones."""
    w = labelled.where((F.col("n_words") >= LEAST_WORDS) & F.col(key).isNotNull() & (F.size("segments") > 0))
    w = w.where((F.size("segments") > 1) | (F.coalesce("label_code", F.lit("")) != F.col("segments")[0]["lang"]))
    return w.select(key, F.posexplode("segments").alias("at", "s")).select(key, (F.col("at") + 1).cast("int").alias("seg_no"), F.col("s.lang").alias("lang"))
