"""Core operators on tiny frames, and registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import random

import pytest
from pyspark.sql import functions as F

from adspark.functions import text as T
from adspark.functions.unicode import nfc
from adspark.operators import dedup, dictionary, evaluate, search, units
from adspark.operators.components import components
from adspark.operators.filters import FilterSpec
from adspark.plans import registry
from adspark.sources.tables import link_headings, read_extractions, read_jsonl, write_partitioned

TINY = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("given", "want"), [
    ("Lehrer⸗ und Lehrerinſtelle", "Lehrer- und Lehrerinstelle"), ("Ver⸗\nmögen", "Vermögen"), ("Zwirn-\nund Wolle", "Zwirn- und Wolle"),
    ("Eiſen-\nHandlung", "Eisen-Handlung"), ("Re⸗ gimente", "Regimente"), (None, ""), ("  a \n b ", "a b"), ("„ja“", '"ja"'), ("völlig", "völlig"),
])
def test_normalize(spark, given, want):
    assert one(spark, given, lambda c: T.normalize_text(nfc(c))) == want


@pytest.mark.parametrize(("given", "want"), [("Correcte", "korrekte"), ("Theil", "teil"), ("nähe", "nahe"), ("familières", "familieres"), ("Straße", "strasse"), ("Cigarre", "zigarre")])
def test_fold(spark, given, want):
    assert one(spark, given, T.fold_spelling) == want == T.fold_query(given)


def test_keys_and_measures(spark):
    assert one(spark, " 1. Köchin! ", T.form_key) == "köchin"
    assert one(spark, "a b c d a b c d a b c d", T.max_ngram_repeat) == 3
    assert one(spark, "kurz", T.max_ngram_repeat) == 0
    assert one(spark, "il padrone della casa cerca una cuoca", T.guess_language) == "it"
    assert one(spark, "12", T.guess_language) == "unknown"
    assert T._indel("abc", "abd") == pytest.approx(2 * 2 / 6) and T._indel("", "") == 1.0


@pytest.mark.parametrize(("phrase", "currency", "amount", "day", "unit"), [
    ("730 fl.", None, 730.0, "1858", 1), ("730 fl.", None, 730.0, "1859", 3), ("42 Groschen", None, 0.42, "1935", 13), ("42 Groschen", "S", 42.0, "1935", 14),
    ("1.690 flor.", None, 1.69, "1870", 18), ("24 Kreuzer CM.", "fl", 0.4, "1870", 1), ("2.500", "S", 2500.0, "1935", 13), ("zweihundert Kronen", "k", 200.0, "1900", 5),
    ("79 fl. 50 kr. ö. W.", None, 7950.0, "1850", 4), ("100 bis 110 Mark", None, 100.0, "1900", 7), ("54 Rpf.", "RM", 0.54, "1938", 15), ("9 Silbergroschen", None, 0.3, "1850", 11),
])
def test_units(spark, phrase, currency, amount, day, unit):
    s = spark.createDataFrame([(f"n_{day}0701_001_region_0001", int(day), 1, phrase, amount, None, currency, "jahr")], "ad_id string, year int, span_start int, phrase string, amount_min double, amount_max double, currency string, period string")
    r = units.convert(s, spark.read.parquet(f"{TINY}/pay_units.parquet")).first()
    assert r.unit_id == unit and not r.uncertain


def test_units_edge_cases(spark):
    schema = "ad_id string, year int, span_start int, phrase string, amount_min double, amount_max double, currency string, period string, posterior string"
    pay = spark.read.parquet(f"{TINY}/pay_units.parquet")
    known = [(f"n_19000101_001_region_{i:04d}", 1900, 1, "600 K", 600.0, None, "K", "jahr", "") for i in range(50)]
    odd = [(None, None, None, None, None, None, None, None, None), ("x", 1900, 1, "", 0.0, None, "", "", ""), ("y", 1900, 1, "nach Übereinkommen " * 3000, 580.0, None, None, "jahr", ""), ("z", 1900, 1, "600 K", 600.0, 700.0, "K", "jahr", ""), ("z", 1900, 1, "600 K", 600.0, 700.0, "K", "jahr", "")]
    r = {x.ad_id: x for x in units.convert(spark.createDataFrame(known + odd, schema), pay).collect() if not (x.ad_id or "").startswith("n_")}
    assert len(r) == 4 and r[None].unit_id is None and r["x"].unit_id is None
    assert r["y"].unit_source is None and r["y"].unit_id == 5 and r["z"].kronen_max == 700.0
    assert units.convert(spark.createDataFrame([], schema), pay).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6), (9, 8), (8, 7), (7, 10), (None, 3)], "a int, b int")
    assert sorted(map(tuple, components(e).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 7), (10, 7)]
    assert components(e.limit(0)).count() == 0


def test_same_ad():
    a = "Gesucht wird eine tüchtige Köchin für ein größeres Haus in Wien, Adresse in der Expedition"
    assert dedup.same_ad(a, a.replace("tüchtige", "tüchtigc")) and not dedup.same_ad(a, a.replace("Köchin", "Lehrerin").replace("Wien", "Brünn"))
    assert not dedup.same_ad("zu kurz", "zu kurz")


def test_common_places_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcde", k=rng.randint(0, 12)) for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        got = dedup.common_places(a, b)
        assert len(got) == length[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_border_text_is_no_exchange():
    a = "Gesucht wird eine tüchtige Köchin für ein größeres Haus in Wien"
    assert dedup.same_ad(a, a + " Anträge an die Expedition") and dedup.compare(a, "Nr. 17 " + a).instead_a == ()
    assert dedup.compare(a, a.replace("Köchin", "Lehrerin")).instead_b == ("Lehrerin",)


def test_deduplicate(spark):
    a = "Gesucht wird eine tüchtige Köchin für ein größeres Haus in Wien, Adresse in der Expedition"
    rows = [("a", "1900-01-01", a, True, 1), ("b", "1900-02-01", a, True, 0), ("c", "1900-03-20", a.replace("tüchtige", "tüchtigc"), True, 0), ("d", "1905-01-01", a, True, 0), ("e", "1900-01-01", a, False, 0), ("f", "1900-01-02", "kurz", True, 0)]
    df = spark.createDataFrame([(i, "n", 1900, d, t, e, f, 0.5) for i, d, t, e, f in rows], "ad_id string, newspaper string, year int, date string, text_norm string, eligible boolean, n_flags int, ocr_support double").withColumn("date", F.col("date").cast("date"))
    got = {r.ad_id: (r.dup_cluster_id, r.dup_cluster_size, r.is_canonical) for r in dedup.deduplicate(df).collect()}
    assert got == {"a": ("b", 3, False), "b": ("b", 3, True), "c": ("b", 3, False), "d": ("d", 1, True), "e": ("e", 1, True), "f": ("f", 1, True)}


def test_sketches_are_shared_out_and_units_alone_in_their_buckets_left_out(spark):
    rng = random.Random(3)
    words = [f"wort{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(30)]
    rows = [(f"{i}_{k}", rng.choice("nm"), 1900, k * 35, t if k % 2 else t.replace("wort1", "wart1", 1), True, 0, 0.5) for i, t in enumerate(texts) for k in range(5)]
    df = spark.createDataFrame(rows, "ad_id string, newspaper string, year int, day int, text_norm string, eligible boolean, n_flags int, ocr_support double").withColumn("date", F.date_add(F.lit("1900-01-01").cast("date"), F.col("day")))
    u = dedup.cut(dedup.units(df, 4))
    shares = [len(p) for p in u.rdd.glom().collect()]
    assert len(shares) == 4 and min(shares) > 0
    keys = {r.unit: {(band, *map(int, part)) for band, part in enumerate(dedup.sketch(r.text_norm).reshape(dedup.BANDS, -1))} for r in u.collect()}
    units = u.collect()
    want = {tuple(sorted((x.unit, y.unit))) for x in units for y in units if x.newspaper == y.newspaper and x.text_norm != y.text_norm and keys[x.unit] & keys[y.unit] and max(y.first_day - x.last_day, x.first_day - y.last_day) <= dedup.WINDOW_DAYS}
    assert want and {tuple(r) for r in dedup.candidate_pairs(u).collect()} == want


def test_keyword_grammar(spark):
    ix = search.keyword_index(spark.createDataFrame([("a", "Gute Köchin gesucht"), ("b", "Gärtner und Gartenarbeiter"), ("c", "Köchin ohne Lohn, freie Wohnung")], "ad_id string, t string"), "ad_id", "t")
    hit = lambda q: sorted(r.ad_id for r in search.keyword(ix, q).collect())
    assert hit("köchin -lohn") == ["a"] and hit('"freie Wohnung"') == ["c"] and hit("Gart*") == ["b"] and hit("köchin OR gärtner") == ["a", "b", "c"] and hit("xyz*") == []
    with pytest.raises(ValueError):
        search.keyword(ix, "-lohn")


def test_filters(spark):
    df = spark.createDataFrame([("a", ["x", None]), ("b", None), ("c", [None])], "ad_id string, position_lemmas array<string>")
    assert [r.ad_id for r in df.where(FilterSpec(position_lemmas=["x"]).column()).collect()] == ["a"]
    assert df.where(FilterSpec().column()).count() == 3
    with pytest.raises(ValueError):
        FilterSpec(benefits=["gold"]).column()


def test_approximate_search_recall(spark):
    v = spark.read.parquet(f"{TINY}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in search.dense(v, q).collect()}
    near = {(r.query_id, r.vec_id) for r in search.approximate(v, q).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_scores_by_hand(spark):
    runs = spark.createDataFrame([(1, "m", 1, "a"), (1, "m", 2, "b")], "query_id int, method string, rank int, ad_id string")
    j = spark.createDataFrame([(1, "a", "a", 1), (1, "b", "b", 2), (1, "c", "c", 0)], "query_id int, ad_id string, cluster string, grade int")
    r = evaluate.scores(runs, j).first()
    assert r.p10 == 0.1 and r.p10_lenient == 0.2 and r.recall == 1.0 and r.ndcg10 == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))


def test_annotate_halves_failing_batches(spark):
    def handler(texts):
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "c"])], "k int, t string").coalesce(1)
    assert {r.k: r.annotation for r in dictionary.annotate(df, "k", "t", handler).collect()} == {0: "A", 1: None, 2: "C"}


def test_extractions(spark, tmp_path):
    head = "Unnamed: 0,metadata,region_id,reading_order,text,post_corrected,min_x,max_x,min_y,max_y,prediction_label,iiif_link,position,gender,salary,salary_importance,salary_period,unspecific_salary,verpflegung,activity,attitude towards work,background,interpersonal,job specific,language"
    row = lambda m, r, i, t, y, lab, pos="", g="": f'{i},{m},{r},1,ocr,"{t}",0,100,{y},{y + 10},{lab},l{i},"{pos}","{g}"' + "," * 11
    f = tmp_path / "x.csv"
    f.write_text("\n".join([head, row("wrz_18700408_013", "region_0001", 0, "KÖCHIN", 0, "heading"), row("wrz_18700408_013", "region_0002", 1, "Köchin\ngesucht", 20, "job_offer", "[(0, 6, 'Köchin')]", "[(0, 6, 'female')]"), row("wrz_18700408_013 (Kopie)", "region_0002", 2, "Köchin\ngesucht", 20, "job_offer"), row("wrz_18700408_013", "region_0003", 3, "weit", 900, "job_offer", "[(0, 4, 'weit')]", "[(1, 4, 'x')]")]), encoding="utf-8")
    ads = link_headings(read_extractions(spark, str(f))).cache()
    got = {r.ad_id[-4:]: r for r in ads.collect()}
    assert set(got) == {"0001", "0002", "0003"} and got["0002"].metadata_raw == "wrz_18700408_013" and got["0002"].heading_text == "KÖCHIN" and got["0003"].heading_ad_id is None
    assert got["0002"].positions[0]["gender"] == "female" and got["0003"].positions[0]["gender"] is None and got["0002"].salary == []
    out = str(tmp_path / "ads")
    write_partitioned(ads.select("ad_id", "newspaper", "year"), out)
    write_partitioned(ads.limit(1).select("ad_id", F.lit("abc").alias("newspaper"), "year"), out)
    assert spark.read.parquet(out).count() == 4


def test_jsonl_skips_broken_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b", "n"\n', encoding="utf-8")
    assert [r.id for r in read_jsonl(spark, str(tmp_path / "l.jsonl"), "id string, n int").collect()] == ["a"]


CHECKED = ["agg_pay_quartiles", "dict_requirements_join_back", "text_normalize", "bm25_topk", "ir_scores", "nearest_in_column", "harmonize_category"]


def cell(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v if isinstance(v, str) else str(v)[:10] if hasattr(v, "isoformat") else round(float(v), 5)


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(TINY):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{TINY}/{f}'")
    df = registry.queries()[name](spark, TINY)
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted(repr([cell(r[names.index(c)]) for c in df.columns]) for r in cur.fetchall())
    assert sorted(repr([cell(v) for v in r]) for r in df.collect()) == want
