"""Helpers shared by the training-data operators: tables, shared scratch space, components."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow rows per Python batch: whole texts are long, so batches stay at a few MB.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small; a setting the user has changed stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a folder of its own only where driver and executors are
    one process and the setting is absent (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quill-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files every executor sees."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored() tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_at.rpartition("/")[0])


def crc_mod(col, n: int):
    """crc32 of the decimal text of an id, modulo n (the contract's fold function)."""
    return F.crc32(F.col(col).cast("string")) % F.lit(n)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: What a Python worker keeps between tasks (tokenizer tables), by key.
KEPT: dict = {}


def release(*but) -> None:
    """Called where a worker begins or ends a kind of task: kept tables but those named give their memory
    back, and what the allocators hold free goes to the system, as an executor and all its workers share
    one memory limit."""
    gone = [k for k in KEPT if k not in but]
    for key in gone:
        del KEPT[key]
    if gone or not but:
        trim()


def trim() -> None:
    """What the allocators hold free goes to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def tidy(run):
    """A function over Arrow batches that begins without tables of other kinds of tasks and leaves no
    free memory with its worker, which may stand idle beside others."""

    @functools.wraps(run)
    def tidied(batches):
        release()
        yield from run(batches)
        release()

    return tidied


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(col)).to_pylist()]


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the edge list (a, b): distinct nodes and, for each, its smallest node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        m = np.minimum(root[x], root[y])
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        np.minimum.at(low, root[x], m)
        np.minimum.at(low, root[y], m)
        low = low[low]
        if np.array_equal(low, root):
            return nodes, nodes[root]
        root = low


def _contract(batches):
    """Replace a task's edges by one star per local component (never more rows than nodes)."""
    keep_a, keep_b, held = [], [], 0

    def squeeze():
        a, b = np.concatenate(keep_a), np.concatenate(keep_b)
        nodes, roots = local_roots(a, b)
        far = nodes != roots
        return nodes[far], roots[far]

    for batch in batches:
        keep_a.append(batch.column(0).to_numpy(zero_copy_only=False))
        keep_b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held > 2_000_000:
            a, b = squeeze()
            if len(a) > 1_000_000:  # will not shrink further here: pass on and start anew
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a, b = a[:0], b[:0]
            keep_a, keep_b, held = [a], [b], len(a)
    if held:
        a, b = squeeze()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table of long ids.

    Returns (node, component_id = smallest reachable node) for nodes that have an edge. Every task
    first contracts its own edges with union-find; then large-star and small-star rounds run on
    tables in the shared folder until nothing changes. No component is ever held by one task: the
    star steps are a partial-aggregated minimum and a join on the node. Raises if max_rounds do not do (each
    round at least halves the paths that are left).
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    e = stored(e.mapInArrow(tidy(_contract), "a long, b long"), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours point at the smallest neighbour
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: smaller neighbours (and the node) point at the smallest of them
        small = large.join(low2, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("x"), "m")
        small = small.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        e, old = stored(small, "star"), e
        discard(old)
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sign["n"], sign["s"]) == seen:
            break
        seen = (sign["n"], sign["s"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = e.groupBy("a").agg(F.min("b").alias("component_id"))
    tops = star.select(F.col("component_id").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return star.select(F.col("a").alias("node"), "component_id").unionByName(tops)
