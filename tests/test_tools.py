import pytest

from papyrine.operators import tools as T
from papyrine.plans.tools import store


@pytest.fixture(scope="module")
def shop(spark, small):
    s = store(spark, small)
    s.links = spark.createDataFrame([(1, "gh", "a/b", True)], "gid long, kind string, repo string, own boolean")
    s.cells = spark.createDataFrame([("graphs", "x", 0.5), ("text", "y", 0.7)], "field string, technique string, score double")
    return s


ARGS = {
    "search_papers": {"query": "learning"}, "similar_papers": {"gid": 1}, "get_paper": {"gid": 1}, "list_topics": {}, "topic_papers": {"topic": "Bila Caches"}, "field_cards": {"query": "learning"},
    "field_trend": {"topic": "Bila Caches"}, "gap_scan": {"topic": "Bila Caches"}, "paper_text": {"gid": 1}, "verify_quote": {"gid": 1, "quote": "x"}, "blue_ocean": {"field": "graphs"},
    "paper_resources": {"gid": 1}, "benchmark_info": {"name": "VubrieskkBench"}, "get_citations": {"gid": 1},
}


@pytest.mark.parametrize("name", sorted(T.TOOLS))
def test_every_tool_runs(spark, shop, name):
    df = T.call(spark, shop, name, **ARGS[name])
    assert "error" not in df.columns and df.count() >= 0


def test_errors_are_answers(spark, shop):
    assert T.call(spark, shop, "no_tool").columns == ["error"] and T.call(spark, shop, "get_paper", wrong=1).columns == ["error"]


def test_unknown_ids_give_nothing(spark, shop):
    assert T.call(spark, shop, "get_paper", gid=-5).count() == 0 and T.call(spark, shop, "topic_papers", topic="nothing").count() == 0


def test_recompute(spark, shop):
    total = T.list_topics(shop).orderBy("topic").first().total
    assert T.recompute(spark, shop, "list_topics", float(total), "total") == "ok"
    assert T.recompute(spark, shop, "list_topics", 123456.0, "total") == "no"
    assert T.recompute(spark, shop, "search_papers", 1.0, "score", query="x") == "na"
