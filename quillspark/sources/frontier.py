"""Crawl of many sources at once, in rounds over a frontier of list pages.

A round asks for one list page of every source that is still active, all in one fetch; only what is new in the
round is read again. A source stops at its last page, at a page that cannot be fetched and at one without a
list; the reason is a value in the log, and the other sources go on. Items are attributed to the first place
(source, page, position) that lists them, urls of the ledger are passed over, and every new url enters the
ledger whether its page can be fetched or not.

fetch is a function of a DataFrame with a url column that adds html and error (null where it worked): a join
with stored pages here, a client's Pandas UDF in a deployment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import html as H
from ..functions import text as X
from ..operators.dedup import keep_first
from ..operators.tables import scratch

Fetch = Callable[[DataFrame], DataFrame]


def from_pages(pages: DataFrame) -> Fetch:
    """Fetches from stored pages (url, html); absent urls and pages without content are failures."""
    held = pages.groupBy("url").agg(F.max("html").alias("html"))

    def fetch(asked: DataFrame) -> DataFrame:
        return asked.join(held, "url", "left").withColumn("error", F.when(F.col("html").isNull(), F.lit("not found")))

    return fetch


def crawl_lists(sources: DataFrame, fetch: Fetch, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """items (source, page, pos, title, href) and log (source, page, outcome), an outcome for each page asked for:
    more, done (the last page), failed or empty. sources: source (long), list_url, max_pages.

    Raises if sources are still active after max_rounds."""
    active = scratch(sources.select(F.col("source").cast("long").alias("source"), "list_url", F.greatest(F.col("max_pages"), F.lit(1)).alias("limit"), F.lit(1).alias("page")))
    rounds = None
    for _ in range(max_rounds):
        got = fetch(active.withColumn("url", H.list_page_url(F.col("list_url"), F.col("page"))))
        listed = H.list_items(got.filter("error is null").select(F.col("source").alias("page_id"), "url", "html"))
        own = listed.groupBy(F.col("page_id").alias("source")).agg(F.collect_list(F.struct("pos", "title", "href")).alias("items"))  # of one page
        # the first page tells how many there are
        limit = F.when(F.col("page") == 1, F.least("limit", H.total_pages(F.col("html")))).otherwise(F.col("limit"))
        outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("items").isNull(), "empty").when(F.col("page") >= F.col("limit"), "done").otherwise("more")
        state = scratch(got.withColumn("limit", limit).join(own, "source", "left").select("source", "list_url", "limit", "page", "items", outcome.alias("outcome")))
        rounds = state if rounds is None else rounds.unionByName(state)
        active = state.filter("outcome = 'more'").select("source", "list_url", "limit", (F.col("page") + 1).alias("page"))
        if not active.head(1):
            return rounds.select("source", "page", F.inline("items")), rounds.select("source", "page", "outcome")
    raise RuntimeError(f"sources are still active after {max_rounds} rounds")


@C.configured
def crawl_details(items: DataFrame, fetch: Fetch, ledger: DataFrame, least: int = C.setting("article_min")) -> DataFrame:
    """One row for each url that the ledger does not hold: url, url_hash, source, page, title, route, html, error.

    route: document, attachments or skip by the page's text and attachments; failed where it could not be
    fetched. The new ledger is the old one and all of these urls."""
    key = X.url_hash(F.col("href"))
    first = keep_first(items.select("source", "page", "pos", "title", "href"), key, ["source", "page", "pos"])
    fresh = first.withColumn("url_hash", key).join(ledger.select("url_hash"), "url_hash", "left_anti").withColumnRenamed("href", "url")
    got = scratch(fetch(fresh).withColumn("page_id", F.monotonically_increasing_id()))
    files = H.links(got.filter("error is null"), only=C.SUFFIX_RE).groupBy("page_id").agg(F.count("*").alias("files"))
    read = got.withColumn("chars", F.length(X.clean_text(H.body_text_udf("html")))).join(files, "page_id", "left")
    route = F.when(F.col("error").isNotNull(), "failed").otherwise(H.page_route(F.col("chars"), F.coalesce("files", F.lit(0)), least=least))
    return read.select("url", "url_hash", "source", "page", "title", route.alias("route"), "html", "error")


def crawl_sources(sources: DataFrame, fetch: Fetch, ledger: DataFrame, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole crawl: details, log of the list pages, and the ledger after it (url_hash, url)."""
    items, log = crawl_lists(sources, fetch, max_rounds)
    details = scratch(crawl_details(items, fetch, ledger))
    return details, log, ledger.select("url_hash", "url").unionByName(details.select("url_hash", "url"))
