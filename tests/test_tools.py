import pytest
from pyspark.sql import functions as F

from adspark.operators import dictionary, index
from adspark.operators.tools import Tools
from adspark.plans import ads
from adspark.runtime import table

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools(spark):
    base = ads.base(spark, TINY).cache()
    return Tools(base, dictionary.ad_positions(table(spark, TINY, "ads"), table(spark, TINY, "position_dict")), dictionary.ad_requirements(table(spark, TINY, "ads"), table(spark, TINY, "requirement_dict")))


def test_search_reports_all_matches_and_shows_the_best(tools):
    got = tools.call("search_ads", {"query": "wird OR Stelle", "k": 2})
    assert got["total_matches"] >= len(got["results"]) == 2 and got["total_countable"] <= got["total_matches"]
    assert tools.call("search_ads", {"query": "xyzzy"})["hint"] and "error" in tools.call("search_ads", {"query": "-x"})
    assert "error" in tools.call("search_ads", {"query": "wird", "k": 26}) and "error" in tools.call("search_ads", "{no json")


def test_records_come_in_the_order_asked_for(tools):
    ids = [r.ad_id for r in tools.clean.orderBy("ad_id").limit(2).collect()][::-1]
    got = tools.call("get_ad", {"ad_ids": [*ids, "nowhere"]})["ads"]
    assert [r["ad_id"] for r in got] == [*ids, "nowhere"] and got[2]["error"] and isinstance(got[0]["text"], str)


def test_aggregate_counts_what_stands_behind_it(tools):
    got = tools.call("aggregate", {"group_by": "decade"})
    assert got["n_ads"] == sum(r["n"] for r in got["rows"]) == tools.clean.where("countable").count()
    part = tools.call("aggregate", {"group_by": "none", "filters": {"keyword": "Wohnung"}})
    assert 0 < part["n_ads"] < got["n_ads"]
    share = tools.call("aggregate", {"measure": "share", "subset": {"keyword": "Wohnung"}})
    assert share["n_subset"] == part["n_ads"] == share["rows"][0]["n"]
    assert "error" in tools.call("aggregate", {"measure": "share"}) and "error" in tools.call("aggregate", {"filters": {"colour": "red"}}) and "error" in tools.call("nothing", {})


def test_concepts(tools):
    got = tools.call("expand_concept", {"terms": ["Koch", " "]})["results"]
    assert got[1]["error"] and set(got[0]) == {"term", "positions", "requirements"}
    assert [s["function"]["name"] for s in tools.specs()] == ["search_ads", "get_ad", "aggregate", "expand_concept"]


def test_index_is_replaced_newspaper_by_newspaper(spark, tmp_path):
    df = spark.createDataFrame([("a1", "a", "gute Köchin"), ("b1", "b", "guter Koch")], "ad_id string, newspaper string, text_norm string").withColumn("searchable", F.lit(True))
    ix = index.Index(spark, str(tmp_path))
    ix.replace(index.rows(df))
    ix.replace(index.rows(df.where("newspaper = 'b'").withColumn("text_norm", F.lit("neue Magd neue"))))
    assert {(r.ad_id, tuple(r.words)) for r in ix.ads.collect()} == {("a1", ("gute", "kokhin")), ("b1", ("neue", "magd", "neue"))}
    assert {(r.term, r.df) for r in ix.vocab.collect()} == {("gute", 1), ("kokhin", 1), ("neue", 1), ("magd", 1)}
    assert [r.ad_id for r in index.ranked(ix.ads, "neu*", ix.vocab).collect()] == ["b1"]
