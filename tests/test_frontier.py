"""The crawl frontier against a sequential crawl of the same site."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.sources import frontier as C


def site():
    """Two sources of three pages, one that breaks off, one without a list, one unknown."""
    page = lambda ids, total: '<ul class="news">' + "".join(f'<li><a href="https://d.org/n/{i}/page.htm">title {i}</a></li>' for i in ids) + f'</ul><a href="list{total}.htm">尾页</a>'
    return {
        "https://a.org/list.htm": page([1, 2, 3], 3), "https://a.org/list2.htm": page([4, 5, 1], 3), "https://a.org/list3.htm": page([6, 7, 8], 3), "https://a.org/list4.htm": page([99, 98, 97], 3),
        "https://b.org/list.htm": page([3, 9, 10], 9), "https://b.org/list3.htm": page([11, 12, 13], 9), "https://c.org/list.htm": "<p>nothing here</p>", "https://e.org/list.htm": page([14, 15, 16], 9), "https://e.org/list2.htm": page([20, 21, 22], 9),
        **{f"https://d.org/n/{i}/page.htm": f"<div class='wp_articlecontent'><p>{'word ' * (100 if i % 2 else 2)}</p></div>" + ("<a href='/f.pdf'>f</a><a href=\"/f.pdf\">f</a>" if i == 4 else "") for i in range(30) if i != 5},
    }


SOURCES = [(1, "https://a.org/list.htm", 50), (2, "https://b.org/list.htm", 50), (3, "https://c.org/list.htm", 50), (4, "https://x.org/list.htm", 50), (5, "https://e.org/list.htm", 1)]


def test_crawl(spark):
    pages = spark.createDataFrame(list(site().items()), "url string, html string")
    known = [2, 7]
    ledger = spark.createDataFrame([(f"https://d.org/n/{i}/page.htm",) for i in known], "url string").withColumn("url_hash", X.url_hash(F.col("url")))
    details, log, after = C.crawl_sources(spark.createDataFrame(SOURCES, "source int, list_url string, max_pages int"), C.from_pages(pages), ledger)
    assert sorted(tuple(r) for r in log.collect()) == [(1, 1, "more"), (1, 2, "more"), (1, 3, "done"), (2, 1, "more"), (2, 2, "failed"), (3, 1, "empty"), (4, 1, "failed"), (5, 1, "done")]
    got = {int(r["url"].split("/")[-2]): (r["source"], r["page"], r["title"]) for r in details.collect()}
    first = {1: (1, 1), 3: (1, 1), 4: (1, 2), 5: (1, 2), 6: (1, 3), 8: (1, 3), 9: (2, 1), 10: (2, 1), 14: (5, 1), 15: (5, 1), 16: (5, 1)}
    assert got == {i: (*at, f"title {i}") for i, at in first.items()}
    route = {int(r["url"].split("/")[-2]): (r["route"], r["error"]) for r in details.collect()}
    assert route[5] == ("failed", "not found") and route[4][0] == "attachments" and route[6][0] == "skip" and route[1][0] == "document"
    assert after.count() == len(first) + len(known) == after.select("url_hash").distinct().count()  # failed pages are recorded too
    again, _, _ = C.crawl_sources(spark.createDataFrame(SOURCES, "source int, list_url string, max_pages int"), C.from_pages(pages), after)
    assert again.count() == 0


def test_rounds_raise_and_no_source_is_no_row(spark):
    pages = spark.createDataFrame(list(site().items()), "url string, html string")
    sources = spark.createDataFrame(SOURCES, "source int, list_url string, max_pages int")
    with pytest.raises(RuntimeError, match="still active after 2 rounds"):
        C.crawl_lists(sources, C.from_pages(pages), max_rounds=2)
    items, log = C.crawl_lists(sources.limit(0), C.from_pages(pages))
    assert items.count() == 0 and log.count() == 0
