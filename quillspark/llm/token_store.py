"""Content-addressed store of token ids.

Layout under one folder (every file is Parquet, so any Spark reader opens it):

  objects/kind=1/  key binary (16), n long, data binary   each distinct chunk once: digest, size, ids
  recipes/         doc_id, n_tokens, start, digests binary, root binary   ascending doc_id, files in order
  manifest/        shard, first_doc, last_doc, n_docs, n_tokens, root     one row per recipe file's shard

A rolling hash over a window of ids cuts each document's id stream, so equal passages give equal
chunks. Ids are stored little-endian in 2 bytes where the vocabulary fits, else 4. A document's
recipe lists its chunks' digests in order; its root hashes them pairwise upwards (Merkle), a shard's
root does so over its documents' roots in ascending order of id. read_back() opens the files anew, holds
the recipes against the manifest (root, documents, ids and start of each shard), recomputes each stored
chunk's digest and crc, joins them to the recipes and checks every document's root; bytes do not move again, as
the crc of a document is composed from its chunks' crcs and lengths.

Null and empty texts hold the end id only. Repeated doc_ids are each kept (recipes are rows), and so are
null ids, before all others; repeated rows share their chunks. Extra columns are ignored. An empty table
gives a store without rows that reads back as an empty table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, shuffle_partitions, texts_of, tidy
from .crc import Joiner
from .tokens import WordChunks, shared

WINDOW, MASK_BITS, LEAST, MOST = 8, 8, 64, 1024
DIGEST = 16
SHARD_DOCS = 100_000  # documents of a shard, about: its roots are hashed in one task
_MUL = np.uint64(0x9E3779B97F4A7C15)


def rolling_marks(ids: np.ndarray) -> np.ndarray:
    """Places behind ids at which the hash of the last WINDOW ids asks for a cut; of many streams at once, as
    no stream is cut within WINDOW ids of its beginning."""
    n = len(ids)
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MUL
    h ^= h >> np.uint64(29)
    roll = np.zeros(n, np.uint64)
    for k in range(min(WINDOW, n)):  # oldest multiplied most
        roll[k:] += h[: n - k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    roll ^= roll >> np.uint64(32)
    return np.flatnonzero((roll & np.uint64((1 << MASK_BITS) - 1)) == 0) + 1


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of one id stream."""
    return _ends(rolling_marks(ids).tolist(), len(ids))


def _ends(marks: list[int], n: int) -> list[int]:
    if n <= LEAST:
        return [n] if n else []
    out, last = [], 0
    for m in [*marks, n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n and m > last:
            out.append(m)
            last = m
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of a list of digests: neighbours are hashed together level by level, an odd one moves up."""
    level = list(digests) or [hashlib.blake2b(b"", digest_size=DIGEST).digest()]
    while len(level) > 1:
        pairs = [hashlib.blake2b(level[i] + level[i + 1], digest_size=DIGEST).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _split(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """One row per document and one per chunk that is new to its task's recent memory."""

    def run(batches):
        table = shared(WordChunks, tokenizer)
        wide = "<u2" if table.lib.get_vocab_size() <= 1 << 16 else "<u4"
        sent: set[bytes] = set()
        tail, unit = np.uint32(end_id).tobytes(), np.dtype(wide).itemsize
        for batch in batches:
            kind, doc, n, key, data = [], [], [], [], []
            raws = [raw + tail for raw in table.encode(texts_of(batch))]
            every = np.frombuffer(b"".join(raws), "<u4")
            bounds = np.cumsum([0, *(len(raw) // 4 for raw in raws)])
            marks, packed = rolling_marks(every), every.astype(wide).tobytes()
            own = np.searchsorted(marks, bounds, "right").tolist()
            bounds, marks = bounds.tolist(), marks.tolist()
            for i, d in enumerate(batch.column(0).to_pylist()):
                at = bounds[i]
                size = bounds[i + 1] - at
                digests, last = [], 0
                for end in _ends([m - at for m in marks[own[i] : own[i + 1]]] if size > LEAST else [], size):
                    part = packed[(at + last) * unit : (at + end) * unit]
                    digests.append(g := hashlib.blake2b(part, digest_size=DIGEST).digest())
                    if g not in sent:
                        sent.add(g)
                        kind.append(1), doc.append(None), n.append(end - last), key.append(g), data.append(part)
                    last = end
                kind.append(0), doc.append(d), n.append(size), key.append(merkle(digests)), data.append(b"".join(digests))
            if len(sent) > 500_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(data, pa.binary())],
                names=["kind", "doc_id", "n", "key", "data"],
            )

    return df.mapInArrow(run, "kind int, doc_id long, n long, key binary, data binary")


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize df's whole texts and write the store to path (a folder all executors reach)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # one exchange by digest keeps each chunk once; documents' rows travel along
    cut = _split(rows, tokenizer, end_id).groupBy("kind", "key", "doc_id").agg(F.first("n").alias("n"), F.first("data").alias("data"), F.count("*").alias("copies"))
    cut.write.partitionBy("kind").parquet(f"{path}/objects")
    n = shuffle_partitions(spark)
    docs = _objects(spark, path, 0)
    n = max(n, -(-(docs.agg(F.sum("copies")).first()[0] or 0) // SHARD_DOCS))
    docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    docs = docs.select("doc_id", F.col("n").alias("n_tokens"), F.col("key").alias("root"), F.col("data").alias("digests"))
    docs.repartitionByRange(n, "doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("shard", F.spark_partition_id()).write.parquet(f"{path}/sorted")
    docs = spark.read.parquet(f"{path}/sorted")
    shards = docs.groupBy("shard").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # one row per shard: its window runs over as many rows as there are shuffle partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards.join(_shard_roots(docs), "shard").write.parquet(f"{path}/manifest")
    inside = Window.partitionBy("shard").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(spark.read.parquet(f"{path}/manifest").select("shard", "shard_start"))
    recipes = docs.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, "shard")
    recipes = recipes.select("shard", "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "digests", "root")
    recipes.write.parquet(f"{path}/recipes")
    delete(spark, f"{path}/sorted")
    delete(spark, f"{path}/objects/kind=0")


def _objects(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """Rows of one kind (1 chunks, 0 documents on their way to recipes); none where no file is."""
    return spark.read.schema("key binary, doc_id long, n long, data binary, copies long, kind int").parquet(f"{path}/objects").filter(F.col("kind") == kind)


def _shard_roots(docs: DataFrame) -> DataFrame:
    """Merkle root of each shard over its documents' roots (about SHARD_DOCS at most) in ascending doc_id order."""

    @F.pandas_udf("binary")
    def root(lists):
        return lists.map(merkle)

    own = F.sort_array(F.collect_list(F.struct("doc_id", "root")))
    return docs.groupBy("shard").agg(own.alias("own")).select("shard", root(F.transform("own", lambda x: x["root"])).alias("root"))


def broken_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose recipes no longer give the manifest's root, counts and start (none in a sound store)."""
    recipes = spark.read.parquet(f"{path}/recipes")
    sums = recipes.groupBy("shard").agg(F.count("*").alias("docs_found"), F.sum("n_tokens").alias("tokens_found"), F.min("start").alias("start_found"))
    now = sums.join(_shard_roots(recipes).withColumnRenamed("root", "found"), "shard")
    pairs = [("root", "found"), ("n_docs", "docs_found"), ("n_tokens", "tokens_found"), ("shard_start", "start_found")]
    broken = F.lit(False)
    for a, b in pairs:
        broken = broken | ~F.col(a).eqNullSafe(F.col(b))
    return spark.read.parquet(f"{path}/manifest").join(now, "shard", "full").filter(broken)


_JOINER = Joiner()  # a worker keeps the tables of the lengths it has met


def _checked(batches):
    for batch in batches:
        digests, sizes, parts = (batch.column(i).to_pylist() for i in range(3))
        for g, data in zip(digests, parts, strict=True):
            if hashlib.blake2b(data, digest_size=DIGEST).digest() != g:
                raise ValueError(f"chunk {g.hex()} does not match its digest")
        short = sum(map(len, parts)) == 2 * sum(sizes)  # one width for all chunks of a store
        ids = memoryview(np.frombuffer(b"".join(parts), "<u2" if short else "<u4").astype("<u4").tobytes())
        ends = np.cumsum([0, *sizes]).tolist()
        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), batch.column(1)], names=["digest", "crc", "n_ids"])


def _composed(batches):
    joiner = _JOINER
    for batch in batches:
        crcs = []
        lists = batch.column(4)
        flat, bounds = lists.flatten(), lists.offsets.to_numpy()
        bounds = (bounds - bounds[0]).tolist()
        pos, crc_of, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "crc", "n_ids"))
        key = flat.field("digest").to_pylist()
        for k, (d, total, digests, root) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
            own = np.argsort(pos[bounds[k] : bounds[k + 1]]) + bounds[k]
            keys = [key[i] for i in own.tolist()]
            if None in keys or b"".join(keys) != digests or merkle(keys) != root:
                raise ValueError(f"document {d}: the recipe does not match its root")
            crc, count = 0, 0
            for c, n in zip(crc_of[own].tolist(), size[own].tolist(), strict=True):
                crc = joiner.join(crc, int(c), 4 * int(n)) if count else int(c)
                count += int(n)
            if count != total:
                raise ValueError(f"document {d}: {count} ids read, {total} in its recipe")
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), batch.column(1), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32; raises on any mismatch."""
    bad = broken_shards(spark, path).select("shard").head(1)
    if bad:
        raise ValueError(f"shard {bad[0]['shard']}: the recipes do not match the manifest")
    chunks = _objects(spark, path, 1).select(F.col("key").alias("digest"), F.col("n").alias("n_ids"), F.col("data").alias("ids"))
    seen = chunks.mapInArrow(tidy(_checked), "digest binary, crc long, n_ids long")
    recipes = spark.read.parquet(f"{path}/recipes")  # start names a row: every document has an id at least
    count = (F.length("digests") / DIGEST).cast("int")
    entries = recipes.select("start", F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"), "digests")
    entries = entries.select("start", "pos", F.expr(f"substring(digests, pos * {DIGEST} + 1, {DIGEST})").alias("digest"))
    found = entries.join(seen, "digest", "left").groupBy("start").agg(F.collect_list(F.struct("pos", "digest", "crc", "n_ids")).alias("parts"))
    rows = recipes.join(found, "start", "left").select("doc_id", "n_tokens", "digests", "root", "parts", "start")
    return rows.mapInArrow(tidy(_composed), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its whole ids again, for training jobs."""
    chunks = _objects(spark, path, 1).select(F.col("key").alias("digest"), F.col("n").alias("n_ids"), F.col("data").alias("ids"))
    recipes = spark.read.parquet(f"{path}/recipes")  # start names a row: every document has an id at least
    count = (F.length("digests") / DIGEST).cast("int")
    entries = recipes.select("start", "doc_id", F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"), "digests")
    entries = entries.withColumn("digest", F.expr(f"substring(digests, pos * {DIGEST} + 1, {DIGEST})")).drop("digests")
    parts = entries.join(chunks, "digest").groupBy("start", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n_ids", "ids"))).alias("parts"))

    @F.pandas_udf("array<int>")
    def whole(parts):
        def one(ps):
            return np.concatenate([np.frombuffer(p["ids"], "<u2" if len(p["ids"]) == 2 * p["n_ids"] else "<u4") for p in ps]).astype(np.int32)

        return parts.map(one)

    return parts.select("doc_id", whole("parts").alias("ids"))
