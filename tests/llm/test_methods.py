"""What the named methods decide, measured on planted cases and against brute force."""

import itertools
import random
from collections import Counter

import numpy as np

from adspark.llm import canonical, keywords, leakage, ocr, packing, repetition, survivor

# ---------------------------------------------------------------- 3 survivors


def test_fields_are_filled_with_the_true_value_nine_times_in_ten(spark):
    """Printings of reliable and unreliable newspapers; the survivor's field is hidden, the truth is known."""
    rng = random.Random(2)
    right = {"good": 0.97, "fair": 0.8, "bad": 0.3}
    ads, texts, dups, truth = [], [], [], {}
    for c in range(150):
        truth[f"k{c}"] = f"value {c}"
        for n in range(rng.randint(3, 6)):
            paper = rng.choice(list(right))
            i = f"{paper}_{c}_{n}"
            said = f"value {c}" if rng.random() < right[paper] else f"wrong {c} {rng.randint(0, 2)}"
            ads.append((i, paper, f"1900-01-{n + 1:02d}", None if n == 0 else said))
            texts.append((i, 0 if n == 0 else 2, 0.5 if n == 0 else 0.4))
            dups.append((i, f"k{c}", False))
    a = spark.createDataFrame(ads, "ad_id string, newspaper string, date string, label string").selectExpr("ad_id", "newspaper", "cast(date as date) date", "label")
    t = spark.createDataFrame(texts, "ad_id string, n_flags int, ocr_support float")
    got = survivor.surviving_records(a, t, spark.createDataFrame(dups, "ad_id string, dup_cluster_id string, is_canonical boolean"), fields=("label",)).collect()
    by_votes = 0.0  # what plain majority would fill, ties shared out
    for c, said in itertools.groupby(sorted((int(i.split("_")[1]), s) for i, _, _, s in ads if s), key=lambda x: x[0]):
        n = Counter(s for _, s in said)
        best = [s for s in n if n[s] == max(n.values())]
        by_votes += (truth[f"k{c}"] in best) / len(best)
    filled = [r.label == truth[r.dup_cluster_id] for r in got]
    assert all(r.filled == ["label"] for r in got) and np.mean(filled) >= 0.9
    assert np.mean(filled) > by_votes / 150 + 0.01


# ---------------------------------------------------------------- 4 repetition


def test_rules_that_disagree_are_weighed_by_their_accuracy():
    rng = random.Random(3)
    patterns: Counter = Counter()
    for _ in range(4000):
        true = rng.random() < 0.2
        vote = lambda p, true=true: int(true) if rng.random() < p else int(not true)
        patterns[tuple([vote(0.97), vote(0.9) if rng.random() < 0.7 else -1, vote(0.9), vote(0.55)])] += 1
    given = sorted((p, float(n)) for p, n in patterns.items())
    prior, table = repetition.fit_votes(given)
    assert 0.15 < prior < 0.25
    correct = [(prior * table[j, 1, 2] + (1 - prior) * table[j, 0, 1]) / (1 - prior * table[j, 1, 0] - (1 - prior) * table[j, 0, 0]) for j in range(4)]
    assert correct[0] > 0.93 and correct[3] < 0.65
    q = repetition.posterior(np.array([(1, 1, 1, 0), (0, 0, 0, 1), (1, -1, 1, 0)]), prior, table)
    assert q[0] > 0.95 and q[1] < 0.05 and q[2] > 0.5


# ---------------------------------------------------------------- 5 scans


def test_all_lexicon_words_within_two_operations_are_reached():
    rng = random.Random(5)
    lexicon = {"".join(rng.choices("abcn", k=rng.randint(3, 6))): 5 for _ in range(300)}
    ed = ocr.Editor(ocr.Knowledge(lexicon, {}, {}))
    ed.learn(Counter({("^", "n", "b"): 3, ("a", "cc", "a"): 4, ("b", "", "c"): 3, ("c", "a", ""): 9, ("a", "b", "n"): 2}))
    assert ed.at == {"n": [("n", "b")], "c": [("cc", "a")], "a": [("a", "")]} and ed.after == {"b": ["c"]}

    def once(prefix, rest):
        """Every way to apply one operation to what is left of a word: (made so far, still left)."""
        for i in range(len(rest) + 1):
            left = rest[i - 1] if i else None
            for x, y in (("n", "b"), ("cc", "a"), ("a", "")):
                if rest.startswith(x, i):
                    yield prefix + rest[:i] + y, rest[i + len(x) :]
            if left == "b" or (not i and prefix.endswith("\0b")):
                yield prefix + rest[:i] + "c", rest[i:]

    for _ in range(100):
        w = "".join(rng.choices("abcn", k=rng.randint(3, 6)))
        one = list(once("", w))
        two = {a + b for p, r in one for a, b in once(p, r)}
        want = ({p + r for p, r in one} | two) & lexicon.keys() - {w}
        assert want <= set(ed.reach(w))


def test_what_is_remembered_of_pages_equals_what_is_read_anew(monkeypatch):
    rng = random.Random(5)
    signs = "aabcdeinrstAEKSäöüßſΣσ019²٣_-=¬.,'\u0308\u0301\u00ad" + " " * 9 + "\t\u00a0"
    know = ocr.Knowledge({}, {}, {"n": {"wiener bote", "nr abc"}})
    for _ in range(4000):
        line = "".join(rng.choices(signs, k=rng.randint(1, 40)))
        if rng.random() < 0.3:
            line = rng.choice(["Seite ", "Nr. ", "No "]) + rng.choice(["wiener bote", "abc", line]) + rng.choice(["", " 3", " vom", " No", " 1a"])
        if not (line := line.strip()):
            continue
        words = ocr._all_words(line)
        assert words == ocr.EACH.findall(ocr.plain(line)) and ocr._named(words) == ocr.TOKEN.findall(ocr.plain(line))
        assert ocr.shape(line, line.split()) == ocr.SHAPE.sub(ocr._symbol, line)[:24]
        core = ocr.PAGE_WORDS.sub("", ocr.letters(line))
        ws = core.split()
        assert know.title("n", line, words) == (ocr._titled(core, know.titles["n"]), bool(ws) and len(ws) <= 6 and ws[-1] in know.ends), line
        p = ocr.unbroken(ocr.plain(line))
        assert ocr.Page(know).witness(line) == (ocr.EACH.findall(p), set(ocr.EACH.findall(p)), {a + "-" + b for a, b in ocr.COMPOUND.findall(p)})
    for _ in range(4000):
        a, b = ("".join(rng.choices("abceinrst", k=rng.randint(2, 9))) for _ in "ab")
        common, longer = sum((Counter(a) & Counter(b)).values()), max(len(a), len(b))
        assert ocr._similar(a, b) == (a != b and common >= 0.5 * longer and (a[:2] == b[:2] or a[-2:] == b[-2:] or common >= 0.7 * longer))
    # Words that were read on one page are not folded and split again on the next.
    page, asked, plain = ocr.Page(know), [], ocr.plain
    scan = "Der Koch sucht eine Stelle in\nWien und die Magd sucht eine in Graz"
    first = page.repair(scan, scan, "n")
    monkeypatch.setattr(ocr, "plain", lambda s: asked.append(s) or plain(s))
    assert page.repair(scan, scan, "n") == first and not asked


# ---------------------------------------------------------------- 6 canonical list


def test_lookups_find_every_spelling_within_the_bound():
    rng = random.Random(6)
    names = ["".join(rng.choices("aeklst", k=rng.randint(3, 9))) for _ in range(200)]
    forms = canonical.Spellings(list(enumerate(names)))
    hit = 0
    for _ in range(300):
        w = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("aeklst")
        f = canonical.fold("".join(w))
        ok = [(c, s) for s in forms.by if (n := min(len(f), len(s))) and canonical.edits(f, s, 2) <= canonical.reachable(n) and (c := canonical.distance(f, s, 2.5)) <= canonical.allowed(n) and not canonical.negated(f, s)]
        got = forms._near(f)
        if ok:
            hit += 1
            assert got is not None and got[0] <= min(ok)[0]
    assert hit > 100


# ---------------------------------------------------------------- 8 containers


def test_remembered_pieces_count_like_whole_texts():
    import base64
    from pathlib import Path

    import tiktoken

    path = str(Path(packing.TOKENIZERS) / packing.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    whole = tiktoken.Encoding("whole", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = packing.counter(path, memory=50)
    for t in ("", " ", "Köchin gesucht,  Lohn 12 fl.\n\n\tAnträge — ſofort  ", "x" * 500 + " <|endoftext|> ", "ä 😀 12345"):
        assert count(t) == len(whole.encode_ordinary(t))


# ---------------------------------------------------------------- 9 leaks


def test_questions_asked_again_with_other_values_are_found_and_their_subject_alone_is_not(spark):
    frame = "wie viele meter tuch bleiben dem weber wenn er von {} ellen jeden tag {} ellen webt und nach {} wochen noch {} ellen auf dem webstuhl liegen die er dem meister bringt"
    rng = random.Random(8)
    vocab = [f"fremd{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    items = [(1, frame.format(120, 7, 3, 15)), *[(i, " ".join(rng.choice(vocab) for _ in range(30)) + " wie viele meter tuch bleiben dem weber wenn er von jeden tag webt und nach noch auf liegen die er bringt") for i in range(2, 6)]]
    again = frame.format(340, 9, 5, 21)
    mixed = " ".join(w if i % 2 or w.isdigit() else rng.choice(vocab) for i, w in enumerate(again.split()))
    docs = spark.createDataFrame([(1, "vorher stand etwas anderes " + again), (2, mixed), (3, "der weber bringt dem meister jeden tag viele ellen tuch und auf dem webstuhl liegen noch ellen")], "doc_id long, text string")
    r = leakage.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert [tuple(x) for x in leakage.found(r).where("item_id = 1").collect()] == [(1, 1)]
    assert r.where("doc_id = 1 and item_id = 1").first().renamed > 0.1


def test_slots_filled_anew_must_be_consistent():
    rows = [(i, f"ein bauer hat {i} kühe und kauft {i} schafe dazu für {i + 1} kronen") for i in range(10, 14)]
    items = leakage.Items(rows, 4)
    item = items.folded[0]
    pairs = [(i, i) for i in range(len(item))]
    same = [leakage.fold(w) for w in "ein bauer hat 77 kühe und kauft 77 schafe dazu für 99 kronen".split()]
    torn = [leakage.fold(w) for w in "ein bauer hat 77 kühe und kauft 78 schafe dazu für 78 kronen".split()]
    assert leakage.refilled(items, item, same, pairs)[2] == 3 and leakage.refilled(items, item, torn, pairs)[2] == 0


# ---------------------------------------------------------------- 10 keywords


def test_what_replication_says_follows_the_collection():
    stitched = keywords.calibrate([(0, 5, 3, 900.0), (0, 0, 3, 100.0), (2, 0, 1, 900.0), (2, 4, 1, 100.0)])
    shuffled = keywords.calibrate([(0, 0, 3, 900.0), (0, 5, 3, 100.0), (2, 4, 1, 900.0), (2, 0, 1, 100.0)])
    assert stitched[5, 3] > 0 > stitched[0, 1] and shuffled[0, 3] > 0 > shuffled[4, 1]


def test_shingles_are_those_of_the_whole_page():
    words = [f"w{i % 7}" for i in range(40)]
    got, kinds = keywords.shingles(words, [0] * 20 + [2] * 20)
    assert len(got) == len({tuple(words[i : i + 5]) for i in range(36)}) == len(kinds) and set(kinds.tolist()) <= {0, 2, -1}
    assert keywords.shingles(words[:4], [0] * 4)[0].size == 0
