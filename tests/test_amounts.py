import datetime as dt

import pytest
from pyspark.sql import functions as F

from adspark.operators import amounts as A

D1855, D1870 = dt.date(1855, 5, 1), dt.date(1870, 5, 1)

AMOUNTS = [
    ("900 fl. (Anzeiger Nr. 12.)", "", D1870, (900, 900, "fl", "öW", "date")),
    ("735 fl. 5. W., Wohnung", "", D1870, (735, 735, "fl", "öW", "stated")),
    ("500 fl. C. M. jährlich", "", D1870, (500, 500, "fl", "CM", "stated")),
    ("500 fl. jährlich", "", D1855, (500, 500, "fl", "CM", "date")),
    ("von 226 fl. 80 kr. öst. W.", "", D1870, (226.8, 226.8, "fl", "öW", "stated")),
    ("30 kr. C. M. und Kost", "", D1855, (0.5, 0.5, "fl", "CM", "stated")),
    ("78½ kr. (Anzeiger", "", D1870, (0.785, 0.785, "fl", "öW", "date")),
    ("1400—1600 K und 180 K Quartiergeld", "", D1870, (1400, 1600, "K", None, None)),
    ("K 400 Quartiergeld", "", D1870, (400, 400, "K", None, None)),
    ("von fl. 1200.— , mit", "", D1870, (1200, 1200, "fl", "öW", "date")),
    ("1.200 fl. jährlich", "", D1870, (1200, 1200, "fl", "öW", "date")),
    ("2 K 20 h ist", "", D1870, (2.2, 2.2, "K", None, None)),
    ("50, resp. 40 fl., oder", "", D1870, (50, 50, "fl", "öW", "date")),
    ("70 bis 80 kr. und", "", D1870, (0.7, 0.8, "fl", "öW", "date")),
    ("50 fl. EM. monatlich", "", D1855, (50, 50, "fl", "CM", "stated")),
    ("160— bis 180— Mädchen", "Mädchen, Lohn Fr.", None, (160, 180, "Fr", None, None)),
    ("400 h , für jährlich 300 K", "", D1870, (None, None, None, None, None)),
    ("Wohnung", "", D1870, (None, None, None, None, None)),
    ("", "", None, (None, None, None, None, None)),
]


def test_amounts(spark):
    df = spark.createDataFrame([(i, t, b, d) for i, (t, b, d, _) in enumerate(AMOUNTS)], "i int, t string, b string, d date")
    got = {r.i: (r.amount_min, r.amount_max, r.currency, r.standard, r.standard_source) for r in A.parse_amount(df, "t", "b", "d").collect()}
    for i, (t, _, _, want) in enumerate(AMOUNTS):
        assert got[i] == pytest.approx(want), t


AROUND = [
    ("Jahresgehalt", " ö. W., Wohnung und Holz.", "735 fl.", ("gehalt", "jahr", "stated")),
    ("diese mit 300 fl. Gehalt,", " Quartiergeld und Kleidung", "42 fl.", ("quartiergeld", "jahr", "assumed")),
    ("jede mit 600 fl. Gehalt,", " Functionszulage, Quartier", "50 fl.", ("zulage", "jahr", "assumed")),
    ("Direction zu Linz, Gehalt", " , Quartiergeld. (Anzeiger", "1050 fl.", ("gehalt", "jahr", "assumed")),
    ("Gehalt", " Activitätszulage und Kleidung", "300 fl,", ("gehalt", "jahr", "assumed")),
    ("eine Quartiergeldentschädigung von jährlich", " , so wie", "450 fl.", ("quartiergeld", "jahr", "stated")),
    ("gegen Erlag einer Dienstcaution von", " zu besetzen.", "400 fl.", ("kaution", None, None)),
    ("mit dem Taggelde von", " vom Amt", "90 kr.", ("taggeld", "tag", "stated")),
    ("in der XX. Diätenclasse mit dem Gehalte von", " und", "735 fl.", ("gehalt", "jahr", "assumed")),
    ("mit jährlichen 500 fl., 450 fl.,", " und 300 fl. Gehalt erledigt", "350 fl.", ("gehalt", "jahr", "stated")),
    ("Jahresgehalt der II. Kategorie", " , Zulage jährlicher 200 K", "1800 K", ("gehalt", "jahr", "stated")),
    ("mit einem Honorar monatlicher", " , die Verpflegung", "100 K", ("remuneration", "monat", "stated")),
    ("1800 K, Quatiergeld der dritten Kategorie jährlicher", " Ferner", "300 K.", ("quartiergeld", "jahr", "stated")),
    ("beide mit", " EM. monatlich Gehalt.", "50 fl.", ("gehalt", "monat", "stated")),
    ("", "", "5", (None, None, None)),
]


def test_components_and_periods(spark):
    df = spark.createDataFrame([(i, b, a, s) for i, (b, a, s, _) in enumerate(AROUND)], "i int, b string, a string, s string")
    got = {r.i: (r.component, r.period, r.period_source) for r in A.classify(df, "b", "a", "s").collect()}
    for i, (b, _, s, want) in enumerate(AROUND):
        assert got[i] == want, (b, s)


def test_spans(spark):
    ads = [
        ("a", D1870, "Stelle, Gehalt 600 fl. ö. W., Activitätszulage 150 fl. und Wohnung.", ["600 fl.", "150 fl."]),
        ("b", D1855, "Diener mit 300 fl., eventuell 250 fl. Gehalt, gegen Caution von 400 fl.", ["300 fl.", "250 fl.", "400 fl."]),
        ("c", D1870, "Taggeld zweihundert Kreuzer.", ["zweihundert Kreuzer"]),
        ("d", D1870, "Brot von 840 Gramm täglich.", ["840 Gramm"]),
        ("e", D1870, "Lohn 2 K 20 h.", ["2 K", "20 h"]),
    ]
    rows = [(i, "n", 1870, d, t, t.index(p), t.index(p) + len(p), p) for i, d, t, ps in ads for p in ps] + [("f", "n", 1870, None, None, 0, 3, "5 K")]
    df = A.parse_spans(spark.createDataFrame(rows, "ad_id string, newspaper string, year int, date date, text string, start int, end int, phrase string"))
    got = {(r.ad_id, r.phrase): r for r in df.collect()}
    assert [got[k].parsed_by for k in (("a", "600 fl."), ("b", "250 fl."), ("c", "zweihundert Kreuzer"), ("d", "840 Gramm"), ("e", "2 K"), ("e", "20 h"), ("f", "5 K"))] == ["rules", "rules", None, "not_money", "rules", "fragment", None]
    assert [got[k].component for k in (("a", "150 fl."), ("b", "300 fl."), ("b", "400 fl."))] == ["zulage", "gehalt", "kaution"] and got["e", "2 K"].amount_min == 2.2
    assert "[zweihundert Kreuzer]" in got["c", "zweihundert Kreuzer"].snippet
    read = A.apply_readings(df, df.where("parsed_by is null").select("snippet", F.lit(2.0).alias("amount_min"), F.lit(2.0).alias("amount_max"), F.lit("fl").alias("currency")))
    assert {r.parsed_by for r in read.where("ad_id = 'c'").collect()} == {"llm"} and read.count() == df.count()
