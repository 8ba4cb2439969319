"""The models are used whenever both classes exist, however few URLs they have."""

from orbitframe.llm import url_filter


def test_one_blocked_url_is_learnt_from(spark):
    rows = [(i, "http://a.net/es/casino") for i in range(40)] + [(100 + i, f"http://b{i}.com/news") for i in range(40)] + [(200, "http://a.org/es/casino")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"))
    assert {r.page_id: r.verdict for r in got.collect()}[200] == "block"
