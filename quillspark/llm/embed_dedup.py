"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its NEAREST reference points (pivots) of a fixed set and enters the inverted
list of each, by label and pivot; two vectors are candidates if they share at least SHARED of them.
Sharing SHARED of NEAREST means meeting in one of the first NEAREST - SHARED + 1 in pivot order, so
only those lists are kept, and a pair is settled in the list of its smallest common pivot: once.
Candidates are verified by cosine in double precision. Pivots are a sample drawn by a hash of the id:
2 * sqrt(vectors), at least 64 and at most MAX_PIVOTS; every vector is indexed. Recall against brute
force on the test tables is 1.0; on drawn pairs of cosine 0.93 it is over 0.99.

Equal vectors of a label are one class with a count. Within a list blocks of BLOCK vectors meet as
matrices, so a hot list is many tasks; they return counts and a spanning forest, never pairs.

Vectors that are null, zero or hold a null or non-finite component, and vectors without a label, link
with nothing; so do vectors of different lengths. Rows of one id with different vectors are joined as
one node. Repeated rows count as other vectors of one id. A null id keeps component null and is kept.
Extra columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_roots, stored, tidy

NEAREST, SHARED, BLOCK, MAX_PIVOTS = 12, 3, 512, 2048


def _packed(a: np.ndarray) -> bytes:
    """The bytes of a component, then the components: 4 where single precision holds all of them exactly."""
    with np.errstate(over="ignore"):
        short = a.astype("<f4")
    return b"\x04" + short.tobytes() if np.array_equal(short, a) else b"\x08" + a.tobytes()


def _length(raw: bytes) -> int:
    return (len(raw) - 1) // raw[0]


def _clean(batches):
    """id, label and the packed vector with a digest; null where it cannot link."""
    for batch in batches:
        raws, marks = [], []
        for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = None
            if v and label is not None and not any(x is None for x in v):
                a = np.array(v, dtype="<f8") + 0.0
                most = float(np.abs(a).max())
                if 0 < most < np.inf:  # scaled by a power of two, so that no square is infinite or vanishes
                    raw = (np.ldexp(a, -np.frexp(most)[1]),)
            raws.append(raw and _packed(raw[0]))
            marks.append(raw and xxhash.xxh3_128_digest(raw[0].tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raws, pa.binary()), pa.array(marks, pa.binary())], names=["id", "label", "vec", "mark"])


def _unit(raws: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision of packed vectors of one length."""
    kinds = {r[0] for r in raws}
    if len(kinds) == 1:
        every = np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), -1)[:, 1:]
        m = np.ascontiguousarray(every).view(f"<f{kinds.pop()}").astype(np.float64)
    else:
        m = np.array([np.frombuffer(r, f"<f{r[0]}", offset=1) for r in raws], np.float64)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _describe(held):
    """Nearest pivots of each vector, in pivot order."""

    def run(batches):
        pivots = held.value
        for batch in batches:
            raws = batch.column(batch.schema.names.index("vec")).to_pylist()
            near: list = [None] * len(raws)
            for dim, p in pivots.items():
                own = [i for i, r in enumerate(raws) if _length(r) == dim]
                for at in range(0, len(own), 2000):
                    part = own[at : at + 2000]
                    cos = _unit([raws[i] for i in part]) @ p.T
                    k = min(NEAREST, len(p))
                    for i, row in zip(part, np.sort(np.argpartition(-cos, k - 1, axis=1)[:, :k], axis=1).tolist(), strict=True):
                        near[i] = row
            for i, r in enumerate(raws):  # a length no pivot has: one list for all of it
                near[i] = near[i] if near[i] is not None else [_length(r)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(batch.num_columns)), pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    return run


def _verify(least: float):
    """One group (list, or pair of blocks of it): links of each member and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        ids, side, weight = (table.column(c).to_numpy() for c in ("id", "side", "copies"))
        pivot = int(table.column("pivot")[0].as_py())
        vecs = table.column("vec").to_pylist()
        links, a_all, b_all = np.zeros(len(ids), np.int64), [], []
        sizes = np.array([_length(v) for v in vecs])
        near_lists = table.column("near").to_pylist()
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            unit = _unit([vecs[i] for i in at])
            most = max(len(near_lists[i]) for i in at)
            own, rank = np.unique(np.concatenate([near_lists[i] for i in at]), return_inverse=True)
            has = np.zeros((len(at), len(own)), np.float32)
            has[np.repeat(np.arange(len(at)), [len(near_lists[i]) for i in at]), rank] = 1
            low = int(np.searchsorted(own, pivot))
            need = min(SHARED, most)
            for lo in range(0, len(at), BLOCK):
                part = has[lo : lo + BLOCK]
                # shared pivots make candidates; a pair belongs to the list of its smallest shared pivot
                x, y = np.nonzero((part @ has.T >= need) & (part[:, :low] @ has[:, :low].T == 0))
                x += lo
                keep = x < y
                keep &= (side[at[x]] < 0) | (side[at[x]] != side[at[y]])
                x, y = x[keep], y[keep]
                for s in range(0, len(x), 20_000):
                    i, j = x[s : s + 20_000], y[s : s + 20_000]
                    good = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
                    i, j = at[i[good]], at[j[good]]
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    a_all.append(i), b_all.append(j)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a_all, b_all))
        nodes, roots = local_roots(ids[a], ids[b]) if len(a) else (ids[:0], ids[:0])
        root = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
        on = np.flatnonzero(links > 0)
        return pa.table([pa.array(ids[on]), pa.array(links[on]), pa.array([root[i] for i in ids[on].tolist()], pa.int64())], names=["id", "links", "root"])

    return run


def link_embeddings(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links (other vectors linked directly), component_id, kept."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = stored(rows.mapInArrow(tidy(_clean), "id long, label string, vec binary, mark binary"), "vectors")
    good = rows.filter("vec is not null and id is not null")
    classes = good.groupBy("label", "mark").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = good.join(classes, ["label", "mark"]).filter("id = rep").dropDuplicates(["id", "label", "mark"]).select("id", "label", "vec", "copies")
    count = classes.count()
    most = min(MAX_PIVOTS, max(64, 2 * math.isqrt(count)))
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").collect()
    pivots = {}
    for size in {_length(r["vec"]) for r in sample}:
        pivots[size] = _unit([r["vec"] for r in sample if _length(r["vec"]) == size])
    held = spark.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors
    described = reps.mapInArrow(tidy(_describe(held)), "id long, label string, vec binary, copies long, near array<int>")
    first = F.expr(f"slice(near, 1, greatest(1, size(near) - {SHARED - 1}))")
    lists = described.withColumn("pivot", F.explode(first))
    sizes = described.select("label", F.explode(first).alias("pivot")).groupBy("label", "pivot").agg(F.count("*").alias("c")).filter("c > 1")
    lists = lists.join(sizes, ["label", "pivot"]).withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("int"))
    lists = lists.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lists = lists.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    lists = lists.withColumn("side", F.when(F.col("lo") == F.col("hi"), F.lit(-1)).otherwise(F.col("blk")))
    lists = lists.select("label", "pivot", "lo", "hi", "side", "id", "copies", "vec", "near")
    found = stored(lists.groupBy("label", "pivot", "lo", "hi").applyInArrow(_verify(least), "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    member = rows.join(classes, ["label", "mark"], "left")
    member = member.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    out = member.select(
        F.col("id").alias(id_col),
        F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component_id", "rep", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
