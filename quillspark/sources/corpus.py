"""Corpus sources: directory scan, header and sidecar metadata, caches, FAQ files, crawl pages."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.html import decode_udf, page_text_udf
from ..functions.text import clean_text, let, strip, title_from_name, url_hash
from ..operators.tables import scratch

DEFAULTS = {"适用对象": C.EVERYONE, "生效学期": C.ALWAYS, "发布日期": "", "原文链接": "manual_upload"}
EVALUATION_SCHEMA = """id string, question string, reference_answer string, user_profile struct<role:string>,
source struct<doc:string,title:string,doc_type:string,chunk_index:int,chunk_id:string>, evidence string"""
LABELLED_SCHEMA = "id string, text string, label string"
FAQ_SCHEMA = "question string, answer string, similar_questions array<string>, tags array<string>"


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """One level of folders: path, folder, name, extension, size, mtime, content; files at the root and
    other extensions are left out."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*")
    parts = F.split("path", "/")
    f = files.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "length", F.col("modificationTime").alias("mtime"), "content")
    f = f.withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return f.filter(F.col("extension").isin(*C.EXTENSIONS) & ~F.col("name").endswith(".meta.json"))


def doc_type(folder: Column) -> Column:
    out = F.lit("手册")
    for name, kind in C.DIR_TYPES.items():
        out = F.when(folder == name, kind).otherwise(out)
    return out


def _read(files: DataFrame) -> DataFrame:
    text = decode_udf("content")
    body = F.when(F.col("extension").isin("html", "htm"), page_text_udf(text)).when(F.col("extension").isin("txt", "md"), text)
    return files.withColumn("text", body).withColumn("error", F.when(F.col("text").isNull(), F.concat(F.lit("no reader for ."), F.col("extension")))).drop("content")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("path", "error")


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and failures: text and Markdown are decoded, HTML is stripped; other formats need a reader.

    A file that cannot be read is a row of failures with its error, never an exception."""
    return _split(_read(files))


def parsed_once(files: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """The same from a written table, so that every file is opened once; and what that pass saw: files, failed,
    bytes (from two columns of the table) and elapsed_s. Observed metrics would tell them too, but a session that
    has had some can no longer run models of pyspark.ml, whose closures take it along."""
    began = time.monotonic()
    rows = scratch(_read(files))
    facts = rows.agg(F.count(F.lit(1)).alias("files"), F.count("error").alias("failed"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return *_split(rows), facts.asDict() | {"elapsed_s": time.monotonic() - began}


_KEY_LINE = f"^【({'|'.join(C.HEADER_KEYS)})】(.*)$"


def _blank_after_key(lines: Column) -> Column:
    """0-based place of the first blank line behind a key line; null if there is none."""
    first = F.array_position(F.transform(lines, lambda x: x.rlike(_KEY_LINE)), F.lit(True))

    def find(at: Column) -> Column:
        blank = F.array_position(F.transform(lines, lambda x, i: (x == "") & (at > 0) & (i >= at)), F.lit(True))
        return F.when(blank > 0, (blank - 1).cast("int"))

    return let(first, find)


def header(text: Column) -> Column:
    """map of the header keys, of the lines before the first blank line after a key; of a repeated key
    the last value counts."""
    lines = F.transform(F.split(text, "\n", -1), strip)

    def pairs(ls: Column) -> Column:
        head = F.slice(ls, 1, F.coalesce(_blank_after_key(ls), F.size(ls)))
        return F.transform(F.filter(head, lambda x: x.rlike(_KEY_LINE)), lambda x: F.struct(F.regexp_extract(x, _KEY_LINE, 1), strip(F.regexp_extract(x, _KEY_LINE, 2))))

    last = let(let(lines, pairs), lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["col1"] == p["col1"])))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    """What follows the header's blank line; the whole text if there is no such line."""
    lines = F.split(text, "\n", -1)
    at = let(F.transform(lines, strip), _blank_after_key)
    return F.when(at.isNotNull(), F.array_join(F.slice(lines, at + 2, F.greatest(F.size(lines), F.lit(1))), "\n")).otherwise(text)


def with_metadata(records: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Header over sidecar over default; an empty title falls back to the file name.

    sidecars: (path, meta map<string,string>), path of the file it belongs to.
    """
    r = records.withColumn("head", F.when(F.col("extension") == "txt", header(F.col("text"))).otherwise(F.create_map().cast("map<string,string>")))
    r = r.join(sidecars, "path", "left") if sidecars is not None else r.withColumn("meta", F.lit(None).cast("map<string,string>"))
    pick = lambda k: F.coalesce(F.col("head")[k], F.col("meta")[k], F.lit(DEFAULTS.get(k)))
    title = F.coalesce(F.nullif(pick("标题"), F.lit("")), title_from_name(F.col("name")))
    return r.select(
        "path", doc_type(F.col("folder")).alias("doc_type"), F.col("folder").alias("topic_tag"),
        clean_text(F.when(F.col("extension") == "txt", body(F.col("text"))).otherwise(F.col("text"))).alias("text"),
        F.struct(
            F.col("path").alias("source_file"), pick("原文链接").alias("source_url"), title.alias("title"), pick("适用对象").alias("target_audience"),
            pick("生效学期").alias("valid_semester"), pick("发布日期").alias("publish_date"),
        ).alias("metadata"),
    )


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """<file>.meta.json files as maps; corrupt ones are empty."""
    raw = spark.read.text(f"{root}/*/*.meta.json", wholetext=True).withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", ""))
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return raw.select("path", F.coalesce(m, F.create_map().cast("map<string,string>")).alias("meta"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of objects; an absent file gives no row, missing fields are null."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, FAQ_SCHEMA)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Questions with reference answers, the chunk they were made of and its evidence."""
    return read_array(spark, path, EVALUATION_SCHEMA)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled utterances; rows whose label is none of the four levels go."""
    return read_array(spark, path, LABELLED_SCHEMA).filter(F.col("label").isin(*C.LEVELS))


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose size and whole-second time the cache does not have: cache (path, length, second)."""
    return files.withColumn("second", F.unix_timestamp("mtime")).join(cache.select("path", "length", "second"), ["path", "length", "second"], "left_anti")


def list_pages(sources: DataFrame) -> DataFrame:
    """List page numbers of each source: 1 to min(total, max_pages); sources (source, total, max_pages)."""
    return sources.select("source", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("total", "max_pages")))).alias("page"))


def crawl(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pages whose url hash is not in the ledger; a url is recorded once seen, fetched or not."""
    fresh = pages.withColumn("url_hash", url_hash(F.col("url"))).join(ledger.select("url_hash"), "url_hash", "left_anti")
    return fresh.dropDuplicates(["url_hash"])
