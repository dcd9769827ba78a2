"""Operators of the llm subpackage on small frames: defined results for nulls, empties, ties, repeats, long texts, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.llm import canonical, keywords, langid, leakage, ocr, packing, queries, repetition, survivor, terms

REC = "field string, text string, n long, mark string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- 1 terms


def test_terms_match_brute_force(spark):
    rng = random.Random(1)
    data = [("f" if i % 3 else "g", " ".join(rng.choice("Köchin Koch u. Magd ſtark 12 zwei".split()) for _ in range(rng.randint(0, 6))), rng.randint(0, 3), "x") for i in range(120)]
    data += [("f", None, 5, None), ("f", "", None, None), ("g", "x" * 50_000 + " Koch", -4, None)]
    want: dict = {}
    import re
    import unicodedata

    for f, t, n, _ in data:
        for w in set(re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", t or "").lower().replace("ſ", "s"))):
            o, c = want.get((f, w), (0, 0))
            want[f, w] = (o + max(n or 0, 0), c + 1)
    got = {(r.field, r.term): (r.occurrences, r.records) for r in terms.term_frequencies(spark.createDataFrame(data, REC), width=4).collect()}
    assert got == want


def test_terms_empty_and_ties(spark):
    assert terms.term_frequencies(spark.createDataFrame([], REC)).count() == 0
    r = terms.term_frequencies(spark.createDataFrame([("f", "a", 1, "")] * 2, REC)).collect()[0]
    assert (r.occurrences, r.records, r.mark) == (2, 2, "common")


# ---------------------------------------------------------------- 2 languages


TEXTS = {
    "de": "Der Meister sucht eine tüchtige Kraft für Küche und Keller gegen freie Wohnung.",
    "fr": "Le patron cherche une bonne cuisinière pour le service de la maison avec de bons certificats.",
    "it": "Il padrone cerca una buona cuoca per il servizio della casa con buoni certificati.",
    "en": "The master is looking for a good cook for the work of the house with good references.",
    "cs": "Majitel mlýna hledá dobrou kuchařku pro domácí práce s dobrým vysvědčením bez prostředníka.",
}


def test_languages(spark):
    data = [(f"{c}{i}", c, t) for i in range(30) for c, t in TEXTS.items()]
    data += [("mix", "de", TEXTS["de"] + " " + TEXTS["it"]), ("wrong", "de", TEXTS["fr"]), ("fine", "fra", TEXTS["fr"]), ("none", None, TEXTS["en"]), ("none", None, TEXTS["en"]), ("null", "de", None), ("empty", "", ""), ("short", "xx", "Koch"), ("long", "und", " ".join([TEXTS["de"]] * 400))]
    r = langid.languages(spark.createDataFrame(data, "ad_id string, lang string, text_norm string"), per_language=60)
    got = {x for x in rows(langid.found(r)) if not x[0][-1].isdigit()}
    assert got == {("mix", 1, "de"), ("mix", 2, "it"), ("wrong", 1, "fr"), ("none", 1, "en"), ("long", 1, "de")}
    assert r.count() == len({d[0] for d in data})


def test_languages_without_labels(spark):
    df = spark.createDataFrame([("a", None, "Ein Wort und noch eines dazu hier")], "ad_id string, lang string, text_norm string")
    assert langid.languages(df).count() == 1
    assert langid.languages(df.limit(0)).count() == 0


def test_forward_backward_sums_to_one_and_agrees_with_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e = rng.normal(size=(1, 3, langid.K))
    b = np.array([[True, False, True]])
    tin, tac, st = rng.normal(size=(langid.K,) * 2), rng.normal(size=(langid.K,) * 2), rng.normal(size=langid.K)
    m, _, _ = langid.forward_backward(e, b, np.array([3]), tin, tac, st)
    want = np.zeros((3, langid.K))
    for y in itertools.product(range(langid.K), repeat=3):
        p = np.exp(st[y[0]] + sum(e[0, t, y[t]] for t in range(3)) + tin[y[0], y[1]] + tac[y[1], y[2]])
        for t in range(3):
            want[t, y[t]] += p
    assert np.allclose(m[0], want / want.sum(1, keepdims=True))


# ---------------------------------------------------------------- 3 survivors


def test_survivors(spark):
    ads = spark.createDataFrame([("a", "n", "1900-01-02", None, None, None), ("b", "n", "1900-01-01", "offer", "H", "t1"), ("c", "n", "1900-01-03", "offer", None, "t1"), ("d", "n", None, "x", None, "t2"), ("a", "n", "1900-01-02", None, None, None)], "ad_id string, newspaper string, date string, label string, heading_text string, text string").selectExpr("ad_id", "newspaper", "cast(date as date) date", "label", "heading_text", "text", "'clash' as size")
    text = spark.createDataFrame([("a", 0, 0.9, "t1", None, "de"), ("b", 0, 0.5, "t1", "h", "de"), ("c", None, 0.99, "t1", None, "it")], "ad_id string, n_flags int, ocr_support float, text_norm string, heading_norm string, lang string")
    dups = spark.createDataFrame([("a", "k", False), ("b", "k", True), ("b", "k", True), ("c", "k", None), ("d", "l", None), (None, "k", True), ("e", None, True)], "ad_id string, dup_cluster_id string, is_canonical boolean")
    s = survivor.surviving_records(ads, text, dups)
    got = {r.dup_cluster_id: r for r in s.collect()}
    assert got["k"].ad_id == "a" and got["k"].label == "offer" and got["k"].text == "t1" and got["k"].heading_text == "H"
    assert got["l"].ad_id == "d" and got["l"].size == 1
    assert rows(survivor.wrongly_marked(s)) == [("k", "a")]
    assert survivor.surviving_records(ads.limit(0), text.limit(0), dups.limit(0)).count() == 0


def test_truth_discovery_prefers_reliable_sources(spark):
    # Source g is right wherever others can confirm it, b is not; in cluster z they stand one against one.
    c = [(f"c{i}", 0, 1, s, 1) for i in range(9) for s in ("g", "h")] + [(f"c{i}", 0, 2, "b", 1) for i in range(9)] + [("z", 0, 1, "g", 1), ("z", 0, 2, "b", 1)]
    won = survivor.discover(spark.createDataFrame(c, "cluster string, field int, value long, source string, n long"))
    assert {r["cluster"]: r["value"] for r in won.collect()}["z"] == 1


def test_truth_discovery_does_not_stop_silently_before_it_converges(spark):
    c = [(f"c{i}", 0, 1, s, 1) for i in range(9) for s in ("g", "h")] + [(f"c{i}", 0, 2, "b", 1) for i in range(9)]
    df = spark.createDataFrame(c, "cluster string, field int, value long, source string, n long")
    with pytest.raises(RuntimeError, match="not converged after 1 rounds"):
        survivor.discover(df, rounds=1)
    assert {r["value"] for r in survivor.discover(df).collect()} == {1}


def test_truth_discovery_decides_in_clusters_of_many_claims(spark):
    # Weights far beyond what an exponential holds: the reliable source wins against more claims of the other one.
    c = [("a", 0, 1, "g", 10_000), ("b", 0, 1, "h", 10_000), ("c", 0, 1, "g", 4_000), ("c", 0, 2, "h", 2_500), ("z", 0, 1, "g", 400), ("z", 0, 2, "h", 700)]
    c += [("y", 0, i, "x", 2_000) for i in range(10)]  # and far below: a source that always contradicts itself
    won = {r["cluster"]: r for r in survivor.discover(spark.createDataFrame(c, "cluster string, field int, value long, source string, n long")).collect()}
    assert won["z"]["value"] == 1 and won["z"]["support"] > 0.99 and abs(won["y"]["support"] - 0.1) < 1e-6


def test_p3_found_runs_nothing_that_its_rows_do_not_need(spark, monkeypatch):
    ads = spark.createDataFrame([("a", "n", None, None), ("b", "n", "offer", "t")], "ad_id string, newspaper string, label string, text string").selectExpr("*", "date'1900-01-01' as date", "cast(null as string) heading_text")
    text = spark.createDataFrame([("a", 0, 0.9), ("b", 1, 0.5)], "ad_id string, n_flags int, ocr_support float").selectExpr("*", "'t' as text_norm", "'h' as heading_norm", "'de' as lang")
    frames = {"ads": ads, "ad_text": text, "ad_dups": spark.createDataFrame([("a", "k", False), ("b", "k", True)], "ad_id string, dup_cluster_id string, is_canonical boolean")}
    monkeypatch.setattr(queries, "table", lambda spark, d, name, *columns: frames[name])
    assert [(r.ad_id, r.label, r.filled) for r in queries.p3_survivors(spark, "").collect()] == [("a", "offer", "label,text")]
    monkeypatch.setattr(survivor, "discover", lambda *_: pytest.fail("truth discovery has no say in which ad survives"))
    assert rows(queries.p3_found(spark, "")) == [("k", "a")]


# ---------------------------------------------------------------- 4 repetition


def brute_share(w):
    if len(w) < 8:
        return 0.0
    hit = set()
    for i in range(len(w) - 3):
        if any(w[j : j + 4] == w[i : i + 4] for j in range(i)):
            hit |= set(range(i, i + 4))
    return len(hit) / len(w)


def test_run_share_matches_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        assert repetition.run_share(w) == pytest.approx(brute_share(w))


def test_short_sentences_that_come_again_are_measured(spark):
    docs = spark.createDataFrame([("a", "Koch gesucht\nMagd gut\nKoch gesucht\nKind und Kegel sind hier"), ("b", None), ("c", "")], "ad_id string, text string")
    got = {r.ad_id: r for r in repetition.repetition(docs).collect()}
    assert got["a"].run_share == 0 and got["a"].sentence_share == pytest.approx(12 / (12 + 8 + 12 + 24)) and got["b"].sentence_share == got["c"].sentence_share == 0


def test_repetition(spark):
    clean = [(f"c{i}", " ".join(f"w{i}x{j}" for j in range(20)), "x") for i in range(40)]
    spam = [(f"s{i}", "Der Koch sucht eine gute Stelle. " * 5, "x") for i in range(8)]
    odd = [("null", None, "x"), ("empty", "", "x"), ("short", "a b c d a b c", "x"), ("s0", "Der Koch sucht eine gute Stelle. " * 5, "x"), ("long", "eins zwei drei vier fünf " * 20_000, "x")]
    docs = spark.createDataFrame(clean + spam + odd, "ad_id string, text string, flag string")
    flags = spark.createDataFrame([("s1", True), ("c1", True), ("c2", False), ("c2", None)], "ad_id string, flag boolean")
    assert {r[0] for r in rows(repetition.found(docs, flags=flags))} == {f"s{i}" for i in range(8)} | {"long"}
    assert repetition.repetition(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 5 scans


def test_scans(spark):
    more = "\nbei freier Wohnung und voller Verpflegung in einem hieſigen Privathauſe für das ganze Jahr"
    body = [("Geſucht wird eine verläßliche Köchin, mit guten Zeug-\nniſſen und", "Geſucht wird eine verläßliche Köchin, mit guten Zeugniſſen und", ""), ("Haus- und Küchenarbeit, Lohn nach Über⸗\neinkommen.", "Haus- und Küchenarbeit, Lohn nach Übereinkommen.", "")]
    data = []
    for i in range(400):
        scan, text = body[i % 2][0] + more, body[i % 2][1] + more.replace("\n", " ")
        if i % 4 == 0:
            scan = f"— {i % 9 + 1} —\n" + scan
        if i % 5 == 0:
            scan = scan.replace("guten", "gutcn").replace("Lohn", "Lohu")
        if i % 3 == 0:
            scan = scan.replace("Haus- und", "Haus-\nund")
        data.append((f"n_{i}", text, scan, "n", 1))
    data += [("null", None, None, None, 1), ("bare", None, "Geſucht wird eine verläßliche Köchin, mit gutcn Zeug-\nniſſen", "n", 1), ("n_0", *data[0][1:])]
    ads = spark.createDataFrame(data, "ad_id string, text string, text_ocr string, newspaper string, items int")
    r = ocr.repair(ads, sample_rows=400)
    got = set(rows(ocr.found(r)))
    assert ("n_0", "furniture", "— 1 —") in got and ("n_0", "split", "zeugnissen") in got and ("n_0", "misread", "guten") in got
    assert ("bare", "split", "zeugnissen") in got and not any(k == "split" and "und" in i for _, k, i in got)
    assert not any(a == "null" for a, _, _ in got)
    texts = {x.ad_id: x.repaired for x in r.collect()}
    assert texts["n_2"] == "Geſucht wird eine verläßliche Köchin, mit guten Zeugniſſen und" + more.replace("\n", " ") and texts["null"] == ""
    assert ocr.repair(ads.limit(0)).count() == 0


def test_titles_and_outer_lines_are_judged_though_the_corrected_text_holds_them():
    title = "wiener allgemeine zeitung"
    body = ["tüchtige Köchin wird in ein gutes Haus gesucht", "auch eine Magd für die Küche und den Keller"]
    page = ocr.Page(ocr.Knowledge({}, {}, {"n": {title}}))
    page.lines.w = {"tTrue": 1.0}
    for at in range(3):
        lines = [*body[:at], "Wiener Allgemeine Zeitung", *body[at:]]
        assert page.repair("\n".join(lines), " ".join(lines), "n")[1] == [("furniture", "Wiener Allgemeine Zeitung")]
    page.lines.w = {"pfirst": 1.0}
    assert ("furniture", body[0]) in page.repair("\n".join(body), " ".join(body), "n")[1]


def test_operations_rebuild_the_word():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(2))
        ops = ocr.operations(a, b)
        assert (a == b) == (not ops)
        assert len(b) - len(a) == sum(len(y) - len(x) for _, x, y in ops)


# ---------------------------------------------------------------- 6 canonical values


def test_positions(spark):
    titles = spark.createDataFrame([(1, "Koch", "Köchin", None), (2, "Kellner", "Kellnerin", ["Servierkraft"]), (3, "Kammerjungfer", None, ["Kammerzofe"]), (4, "Weber", "Weberin", None)], "title_id long, title string, female_title string, aliases array<string>")
    data = [(1, "Koch"), (2, "zwei Kocb u. Kelnerin"), (3, "Kammerzofenstelle"), (4, "Seiltänzer"), (5, None), (6, " "), (7, "Servierkraft in Wien"), (2, "zwei Kocb u. Kelnerin"), (8, "Kell."), (9, "x" * 20_000), (10, "Bewerber"), (11, "Köcbin, verheiratet")]
    e = "array<struct<term:string,lemma:string,modern:string,gender_form:string,category:string>>"
    df = spark.createDataFrame([(i, s, None, 0) for i, s in data], f"form_id long, surface string, entries {e}, exact int")
    got = [(r.row_id, r.item_no, r.ref_id) for r in canonical.map_positions(df, titles).orderBy("row_id", "item_no").collect()]
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 1, 3), (4, 1, 0), (7, 1, 2), (8, 1, 2), (9, 1, 0), (10, 1, 0), (11, 1, 1)]
    assert canonical.map_positions(df.limit(0), titles).count() == 0
    assert {r.ref_id for r in canonical.map_positions(df, titles.limit(0)).collect()} == {0}


def test_tags_and_learned_synonyms(spark):
    vals = spark.createDataFrame([(1, "religion", "israelitisch"), (2, "religion", "katholisch"), (3, "familienstand", "ledig"), (4, "familienstand", "verheiratet")], "value_id long, dimension string, value_name string")
    tag = lambda d, v: [(d, v)]
    data = [(i, "israelitisch", tag("religion", "israelitisch")) for i in range(3)] + [(10 + i, "israelitisch", tag("religion", "mosaisch")) for i in range(3)]
    data += [(20, "katholisch", tag("religion", "Esperanto")), (21, "ledig", tag("familienstand", "unverheirathet")), (22, "verh.", tag("familienstand", "verh.")), (23, None, None), (24, "x", tag("religion", None)), (25, "k", tag("religion", "cathol."))]
    df = spark.createDataFrame(data, "req_id long, surface string, tags array<struct<dimension:string,value:string>>")
    got = {r.row_id: (r.ref_id, r.by, r.exact) for r in canonical.map_tags(df, vals).collect()}
    assert got[0] == (1, "form", True) and got[10] == (1, "phrase", False) and got[20][0] == 0 and got[21][0] != 4 and got[22][0] == 4 and got[25][0] == 2
    assert 23 not in got and 24 not in got
    assert canonical.map_tags(df.limit(0), vals).count() == 0


def test_distance_is_symmetric_and_bounded_by_levenshtein():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("kochlin") for _ in range(rng.randint(1, 7))) for _ in range(2))
        assert canonical.distance(a, b, 9) == pytest.approx(canonical.distance(b, a, 9)) and canonical.distance(a, b, 9) <= leakage._edits(a, b, 9)


# ---------------------------------------------------------------- 8 packing


def test_best_fit_never_overfills_and_keeps_all():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(0, 2049, rng.integers(0, 200))
        b, off, final = packing.best_fit(sizes)
        for k in range(len(final)):
            own = sizes[b == k]
            assert own.sum() <= final[k] <= 2048 and sorted(off[b == k]) == sorted(np.r_[0, np.cumsum(np.sort(own)[::-1])[:-1]].astype(int)) if len(own) else True
        assert sizes.sum() <= final.sum()


def test_pack(spark):
    data = [(i, "wort " * n, "x") for i, n in enumerate((0, 3, 500, 9000, 400))] + [(5, None, "x"), (1, "wort " * 3, "x"), (None, "ein", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, position string")
    p = packing.pack(df).toPandas()
    assert len(p[p.doc_id != 3]) == 6 and (p.groupby("container").n_tokens.sum() <= p.groupby("container").container_size.first()).all()
    big = p[p.doc_id == 3].sort_values("piece")
    assert len(big) == -(-big.n_tokens.sum() // 2048) and (big.n_tokens.iloc[:-1] == 2048).all() and (big.first_token == big.piece * 2048).all()
    assert packing.pack(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9 leaks


def test_leaks(spark):
    rng = random.Random(4)
    vocab = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(20)]
    w = items[3][1].split()
    noise = " ".join(rng.choice(vocab) for _ in range(30))
    docs = [(1, noise + " " + " ".join(w) + " " + noise), (2, " ".join(w[5:33]).upper()), (3, " ".join(w[:12])), (4, noise), (5, None), (6, ""), (7, " ".join(x if i % 7 else "etwa" for i, x in enumerate(w))), (8, noise + "\n" + "\n— 4 —\n".join((" ".join(w[:20]), " ".join(w[20:])))), (1, items[3][1]), (9, (noise + " ") * 400 + " ".join(w))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id")
    it = spark.createDataFrame([*items, (99, None), items[3]], "item_id long, text string")
    r = leakage.leaks(d, it)
    assert rows(leakage.found(r)) == [(1, 3), (2, 3), (7, 3), (8, 3), (9, 3)]
    assert leakage.leaks(d.limit(0), it).count() == 0 and leakage.leaks(d, it.limit(0)).count() == 0


def test_every_half_of_an_item_of_rare_words_is_found():
    rng = random.Random(9)
    vocab = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(30)]
    texts.append(" ".join(f"eigen{chr(97 + i)}{chr(122 - i)}" if i % 3 else rng.choice(vocab) for i in range(24)))
    items = leakage.Items(list(enumerate(texts)), 4)
    for n, text in enumerate(texts):
        w = text.split()
        half = (len(w) + 1) // 2
        for at in range(len(w) - half + 1):
            got = {x["item_id"] for x in leakage.leaks_in(" ".join(w[at : at + half]), items, 0.25) if leakage.repeats(x["matched"], x["coverage"])}
            assert n in got


# ---------------------------------------------------------------- 10 keywords


def test_stuffed(spark):
    sentence = "Der Meister sucht eine tüchtige Kraft für die Küche in der Stadt und gibt ihr freie Wohnung. "
    spam = [f"Koch Wien {t} Kellner Graz {t} Koch Linz {t} Magd Wien {t} Koch Graz offen" for t in ("neu", "billig", "sofort")]
    data = [(1, sentence * 4, "a", 0), (2, "\n".join(spam), "b", 0), (3, "[Koch](http://x.invalid/a.html)\n- [Magd](http://x.invalid/b.html)", "c", 0), (4, "#koch #wien #neu #graz", None, 0), (5, None, "a", 0), (6, "", "a", 0)]
    data += [(7, "Marktpreise\nWeizen 3 fl. 77 kr. per Metzen\nKorn 4 fl. 59 kr. per Metzen", "d", 0), (8, "\n".join(f"{i}. Berger F., Koch in Wien, eingetreten 1900" for i in range(9)), "d", 0), (9, sentence + spam[0][:20], "d", 0), (10, sentence * 3000, "e", 0), (2, "\n".join(spam), "b", 0)]
    r = keywords.stuffed(spark.createDataFrame(data, "doc_id long, text string, source string, host int"))
    assert sorted(x.doc_id for x in r.where("flagged").collect()) == [2, 3, 4] and r.count() == 10
    assert keywords.stuffed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_stuffed_calibrates_on_all_pages(spark, monkeypatch):
    seen = []
    calibrate = keywords.calibrate
    monkeypatch.setattr(keywords, "calibrate", lambda counts: seen.append(counts) or calibrate(counts))
    # Each page: 8 words of text, and 6 without function words that density leaves open.
    docs = spark.range(7_000).selectExpr("id as doc_id", "concat('Der Koch und die Magd in Wien ', id, '. Suppe Braten Kuchen Wein Bier ', id) as text", "cast(id % 3 as string) as source")
    r = keywords.stuffed(docs).agg(F.count("*"), F.count("replicated_share"), F.min("replicated_share")).first()
    assert sum(n for *_, n in seen[0]) == 7_000 * 8 and tuple(r) == (7_000, 7_000, 0.5)


def test_replicated_shingles(spark):
    said = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (1, 7), (2, 5), (2, 5), (3, 6), (3, 7)], "shingle long, host long")
    assert [[x for x, _ in rows(keywords.replicated(said, n))] for n in (1, 2, 3, 4)] == [[1, 2, 3], [1, 3], [1], []]
