"""Sinks: index tables with replace by source, append-only memory and alert tables, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import replaced
from ..operators.tables import scratch


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("mergeSchema", "true").parquet(path)


def replace_by_source(df: DataFrame, path: str, key: str = "source_file", buckets: int = 64) -> None:
    """Sources in df replace their rows at path; the rest stays. Only touched buckets are rewritten."""
    spark = df.sparkSession
    df = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        touched = df.select("bucket").distinct()  # at most `buckets` rows
        old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi")
        df = scratch(replaced(old.select(*df.columns), df, key))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    scratch(df).write.mode("overwrite").parquet(path)


def reset(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def submit_alerts(alerts: DataFrame, path: str, notify=None) -> dict:
    """Table write and notice are independent; neither failure stops the other."""
    done = {"stored": False, "notified": False}
    try:
        append(alerts, path)
        done["stored"] = True
    except Exception as e:  # the reply must go out all the same
        done["error"] = str(e)[:200]
    if notify is not None:
        try:
            notify(alerts)
            done["notified"] = True
        except Exception as e:
            done["notice_error"] = str(e)[:200]
    return done


def ensure_table(spark: SparkSession, path: str, schema: str) -> str:
    """Make an empty table where there is none; give an old one the columns it lacks (null in its rows).

    Returns created, repaired or kept."""
    wanted = spark.createDataFrame([], schema)
    if not _exists(spark, path):
        wanted.write.parquet(path)
        return "created"
    have = spark.read.option("mergeSchema", "true").parquet(path)
    if {c.lower() for c in wanted.columns} <= {c.lower() for c in have.columns}:
        return "kept"
    overwrite(have.unionByName(wanted, allowMissingColumns=True), path)
    return "repaired"


def swap_in(df: DataFrame, path: str) -> None:
    """Write df beside path, then put it in path's place by two renames. The old table stays until the new one is
    in place and comes back if that fails; between the renames a reader finds no table, never half of one."""
    spark = df.sparkSession
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    here, there, aside = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (new, path, old))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new)
        had = fs.exists(there)
        if had and not fs.rename(there, aside):
            raise OSError(f"{path} could not be renamed to {old}")
        if not fs.rename(here, there):
            if had:
                fs.rename(aside, there)
            raise OSError(f"{new} could not be renamed to {path}")
    except BaseException:
        fs.delete(here, True)
        raise
    fs.delete(aside, True)


def write_parse_cache(records: DataFrame, path: str) -> None:
    """Parsed records by path, size and whole second, for corpus.uncached()."""
    swap_in(records.withColumn("second", F.unix_timestamp("mtime")).select("path", "length", "second", "text"), path)


def _one_file_each(rows: DataFrame, path: str) -> None:
    """rows: file_name, value. A folder for each name with one text file in it."""
    rows.repartition("file_name").write.mode("overwrite").partitionBy("file_name").option("lineSep", "\x00").text(path)


def sidecar_files(docs: DataFrame, path: str) -> None:
    """One JSON file per document with its metadata, named after the document."""
    _one_file_each(docs.select(F.concat("file_name", F.lit(".meta.json")).alias("file_name"), F.to_json("metadata").alias("value")), path)


def document_files(docs: DataFrame, path: str) -> None:
    """One text file per document (file_name, metadata, text): header lines, a blank line, the body."""
    m = F.col("metadata")
    head = F.concat(
        F.lit("【标题】"), m["title"], F.lit("\n【发布日期】"), m["publish_date"], F.lit("\n【原文链接】"), m["source_url"],
        F.lit("\n【适用对象】"), m["target_audience"], F.lit("\n【生效学期】"), m["valid_semester"], F.lit("\n\n"), F.col("text"),
    )
    _one_file_each(docs.select("file_name", head.alias("value")), path)


def attachments(files: DataFrame, least: int, most: int) -> DataFrame:
    """binaryFile rows within the size bounds, with the name <title>_<8 of hash>.<extension>."""
    ok = files.filter(F.col("length").between(least, most))
    return ok.withColumn("file_name", F.concat("title", F.lit("_"), F.left("url_hash", F.lit(8)), F.lit("."), "extension"))


def report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report of bounded size as one file; CSV begins with a byte order mark, as spreadsheets want it."""
    if kind == "csv":
        df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.coalesce(1).write.mode("overwrite").json(path)


def provenance(spark: SparkSession, path: str, **facts) -> None:
    """How a data set was made: one JSON object of its counts, seeds and limits."""
    row = {k: json.dumps(v, ensure_ascii=False) for k, v in sorted(facts.items())}
    text = "{" + ", ".join(f"{json.dumps(k)}: {v}" for k, v in row.items()) + "}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def build_index(chunks: DataFrame, faq: DataFrame, failures: DataFrame, path: str, rebuild: bool = False) -> dict:
    """Write both tables and return chunk_count, faq_rows and failed_files. Every input is made once, as a written
    table, and counted there by its footers."""
    spark = chunks.sparkSession
    if rebuild:
        reset(spark, f"{path}/chunks", f"{path}/faq")
    own, entries, failed = (scratch(df) for df in (chunks, faq, failures))
    entries.write.mode("overwrite").parquet(f"{path}/faq")
    replace_by_source(own, f"{path}/chunks")
    failed.write.mode("overwrite").parquet(f"{path}/failures")
    return {"chunk_count": own.count(), "faq_rows": entries.count(), "failed_files": failed.count()}
