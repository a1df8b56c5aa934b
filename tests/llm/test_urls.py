import pytest
from pyspark.sql import functions as F

from docketry.llm import urls

RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
)
PAGES = [
    (1, "http://A.example.org/es/x?b=2&a=1"),
    (2, "https://example.org/en/12"),
    (3, "http://notexample.org/es/x"),
    (4, "http://spam.net/a/?utm_source=f&b=2&a=1#top"),
    (5, "https://www.spam.net/a?a=1&b=2"),
    (6, "http://spam.net/a?a=1"),
    (7, None),
    (8, "no scheme"),
    (9, ""),
    (10, "http://example.org"),
    (11, "http://SPAM.net/A?a=1&b=2"),
    (4, "http://spam.net/a/?utm_source=f&b=2&a=1#top"),
    (None, "http://spam.net/a?b=2&a=1"),
]


def judged(spark, pages, listed, blocks):
    out = urls.filter_urls(
        spark.createDataFrame(pages, "page_id long, url string").withColumns(
            {"host": F.lit("x"), "block": F.lit("x"), "canonical": F.lit("x")}
        ),
        spark.createDataFrame([(u,) for u in listed], "url string"),
        RULES,
        blocks=blocks,
    )
    return sorted(((r.page_id, r.host, r.path, r.rule, r.listed, r.verdict) for r in out.collect()), key=repr)


@pytest.mark.parametrize("blocks", [1, 8, urls.BLOCKS])
def test_verdicts_do_not_depend_on_the_filter(spark, blocks):
    got = judged(spark, PAGES, ["spam.net/a?a=1&b=2", "spam.net/a?a=1&b=2", None], blocks)
    verdict = {}
    for page, *_, rule, listed, decision in got:
        verdict.setdefault(page, []).append((rule, listed, decision))
    assert verdict[1] == [("example.org/es/", False, "block")]
    assert verdict[2] == [("example.org/en/1", False, "block")]
    assert verdict[3] == [("org/", False, "allow")]
    assert verdict[4] == [(None, True, "block")] * 2
    assert verdict[5] == verdict[None] == [(None, True, "block")]
    assert verdict[6] == verdict[11] == [(None, False, "allow")]
    assert verdict[7] == verdict[8] == verdict[9] == verdict[10] == [(None, False, "allow")]


def test_many_listed(spark):
    listed = [f"h{i}.net/p{i}" for i in range(500)]
    pages = [(i, f"http://h{i}.net/p{i}" if i % 2 else f"http://h{i}.net/q{i}") for i in range(500)]
    got = judged(spark, pages, listed, 4)
    assert [r[0] for r in got if r[-1] == "block"] == sorted(
        (i for i in range(500) if i % 2), key=lambda i: repr((i,))
    ) or {r[0] for r in got if r[-1] == "block"} == {i for i in range(500) if i % 2}


def test_empty_tables(spark):
    assert judged(spark, [], ["a.b/c"], 8) == []
    assert [r[-1] for r in judged(spark, PAGES[3:5], [], 8)] == ["allow", "allow"]
