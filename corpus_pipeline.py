"""The corpus pipeline: language, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of documents: doc_id, text, lang, source, n_chars. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, minhash, packing, pii, substring
from quillspark.llm.common import discard, stored, table
from quillspark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose best language has less of its n-grams of letters than this is in no known language.
LEAST_SHARE = 0.35
#: Words a worker's tokenizer table holds: the stages before have filled the executors' heaps.
TABLE_CHUNKS = 250_000
#: Windows a task of repeated_passages holds at once, for the same reason; results are the same at any number.
BLOCK_WINDOWS = 300_000


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, texts without letters and texts in no known language go; lang becomes the prediction."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.fit(docs), cover=True)
    found = found.filter((F.col("lang_pred") != "und") & (F.col("covered") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest id. Equal rows count as one document.

    Rows without an id link with nothing and all stay.
    """
    docs = docs.select(*COLUMNS)
    found = stored(minhash.near_duplicates(docs, width=5, percent=80), "near")
    found = found.filter("doc_id is not null")
    # the ids have no bound, so this is a sort-merge join at every size and its shuffle grows as the texts do
    out = docs.join(found.filter("kept").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    if found.groupBy("doc_id").count().filter("count > 1").head(1):
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.filter("doc_id is null"))  # null equals nothing in the join


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier go; a document none of whose words is left goes."""
    docs = docs.select(*COLUMNS)
    cut = substring.remove_repeats(docs, width=20, outputs=("n_words", "n_removed", "kept"), carry=("text", "lang", "source"), block_windows=BLOCK_WINDOWS)
    cut = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _with_length(cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in a text is replaced by its kind in brackets."""
    docs = docs.select(*COLUMNS)
    return _with_length(pii.mask(docs, pii.fit(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2, table_chunks=TABLE_CHUNKS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Stages with trained models have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
            if before is not None:
                discard(before)  # its successor holds all that it kept
            before = docs
    return docs
