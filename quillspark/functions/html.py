"""Page structure with the standard library's parser, as Arrow-batched pandas UDFs and a few regexes."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style"))


class Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs or {}, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.items.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.items.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def block_text(node: Node, skip=None) -> str:
    """Text with line breaks at block tags only; runs of blanks and of breaks squeezed."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in _HIDDEN or skip is not None and skip(x):
            continue
        if x.tag in C.BLOCK_TAGS:
            out.append("\n")
            stack.append("\n")
        stack.extend(reversed(x.items))
    lines = [re.sub(r"[ \t　\xa0]+", " ", line).strip() for line in "".join(out).split("\n")]
    return "\n".join(line for line in lines if line)


def _has_class(node: Node, name: str) -> bool:
    return name in node.attrs.get("class", "").split()


def body_text(html: str | None) -> str:
    """Longest of the first matches of the body selectors; "" if none matches."""
    nodes = list(parse(html).walk())
    best = ""
    for tag, name in C.BODY_SELECTORS:
        hit = next((n for n in nodes if n.tag == tag and (name is None or _has_class(n, name))), None)
        if hit is not None:
            text = block_text(hit)
            best = text if len(text) > len(best) else best
    return best


def page_text(html: str | None) -> str:
    """Whole page without scripts, navigation and elements whose class or id names such parts."""
    noise = re.compile(C.PAGE_NOISE)
    drop = lambda n: n.tag in ("nav", "footer", "header") or bool(noise.search(n.attrs.get("class", "")) or noise.search(n.attrs.get("id", "")))
    return block_text(parse(html), drop)


def decode_page(raw: bytes | None, header: str | None = None) -> str | None:
    """Declared charset first, then the header's, then utf-8; what cannot be decoded is replaced."""
    if raw is None:
        return None
    said = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", raw[:4096])
    for name in (said.group(1).decode() if said else None, header, "utf-8", "gb18030"):
        if name:
            try:
                return raw.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
    return raw.decode("utf-8", "replace")


def _anchor_groups(html: str | None, base: str | None) -> list[dict]:
    """Detail links with the key of their nearest marked ancestor, in document order."""
    out, keys = [], {}
    for node in parse(html).walk():
        href = node.attrs.get("href", "") if node.tag == "a" else ""
        url = urljoin(base or "", href)
        if not href or not urlparse(url).path.endswith("page.htm"):
            continue
        up, depth = node.parent, 0
        while up is not None and depth < C.DEFAULT.ancestor_depth and not (up.attrs.get("class") or up.attrs.get("id")):
            up, depth = up.parent, depth + 1
        marked = up if up is not None and depth < C.DEFAULT.ancestor_depth else None
        key = keys.setdefault(id(marked), len(keys))
        title = re.sub(r"\s+", " ", block_text(node)).strip()
        out.append({"grp": key, "pos": len(out), "title": title, "href": url})
    return out


# types as objects: workers import this module without a session
_ANCHORS = T.ArrayType(T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("href", T.StringType())]))


@F.pandas_udf(T.StringType())
def body_text_udf(html: pd.Series) -> pd.Series:
    return html.map(body_text)


@F.pandas_udf(T.StringType())
def page_text_udf(html: pd.Series) -> pd.Series:
    return html.map(page_text)


@F.pandas_udf(T.StringType())
def decode_udf(raw: pd.Series) -> pd.Series:
    return raw.map(decode_page)


@F.pandas_udf(_ANCHORS)
def anchors_udf(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([_anchor_groups(h, b) for h, b in zip(html, base, strict=True)])


def page_title(html: Column, url: Column) -> Column:
    """<title> text, else the url."""
    inside = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(inside, F.lit("")), url)


def total_pages(html: Column) -> Column:
    """Page number of the link to the last page, else 1."""
    n = F.regexp_extract(html, r"(?s)href=[\"'][^\"']*list(\d+)\.htm[^\"']*[\"'][^>]*>\s*尾页", 1)
    return F.coalesce(F.try_to_number(F.nullif(n, F.lit("")), F.lit("999999")).cast("int"), F.lit(1))


def list_page_url(base: Column, n: Column) -> Column:
    """Address of the n-th list page: list.htm, list2.htm and so on."""
    return F.when(n == 1, base).otherwise(F.concat(F.regexp_replace(base, r"list\.htm$", "list"), n.cast("string"), F.lit(".htm")))


def links(pages: DataFrame, pattern: str = r"href=\"([^\"]+)\"", only: str | None = None) -> DataFrame:
    """page_id, href, pos: distinct hrefs at their first position."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("pos", "href"))
    if only:
        found = found.filter(F.col("href").rlike(only))
    return found.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))


@C.configured
def list_items(pages: DataFrame, least: int = C.setting("list_min")) -> DataFrame:
    """page_id, pos, title, href of the largest link group of each page (first on ties), if large enough."""
    a = pages.select("page_id", F.explode(anchors_udf("html", "url")).alias("a")).select("page_id", "a.*")
    size = a.groupBy("page_id", "grp").agg(F.count("*").alias("n"))
    best = size.groupBy("page_id").agg(F.max_by("grp", F.struct("n", -F.col("grp"))).alias("grp"), F.max("n").alias("n")).filter(F.col("n") >= least)
    kept = a.join(best.select("page_id", "grp"), ["page_id", "grp"]).withColumn("title", F.regexp_replace("title", C.TITLE_PREFIX, "")).filter("title <> ''")
    first = kept.groupBy("page_id", "href").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))
    return first.select("page_id", "pos", "title", "href")


@C.configured
def page_route(body_chars: Column, attachments: Column, least: int = C.setting("article_min")) -> Column:
    return F.when(body_chars >= least, "document").when(attachments > 0, "attachments").otherwise("skip")
