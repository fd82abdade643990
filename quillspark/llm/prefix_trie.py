"""Prefix trie of conversations by distributed MSD radix partitioning over dictionary-encoded turns.

  dictionary   every distinct turn (role, text; by SHA-256) gets a dense number; turns find theirs by a join.
               The numbers of very frequent turns are broadcast (those with over a FREQUENT_SHARE-th of all
               turns: fewer than FREQUENT_SHARE), the others are joined by a shuffle
  rebuild      conversation c is the first h turns of conversation c - c % block, then its own after its
               first h; equal ones are one sequence with a number of members
  radix        a bucket holds the sequences that share their first turns. Large buckets are dealt by their
               next turn in one round for all of them; turns that all of a bucket share are passed over at
               once, so every round splits. A bucket of at most LOCAL turns is local
  finish       local buckets are finished in tasks by multikey quicksort: items are parted into smaller,
               equal and larger at one turn; the equal ones are a node, whose recursion goes one turn deeper
  totals       leaves and saved tokens of a local bucket's top are summed up to the large buckets above

Only rows of bounded size reach a task together: a conversation (one array of numbers), a local bucket.
The ids behind ends_sha256 are ranged by (sequence, id) over all tasks, put together in pieces there, and the
pieces of one sequence pass its hash one after another; SHA-256 allows no other way.

Turns go by turn (null first), those of equal turn by SHA-256 of role and text. Null roles and texts are
empty ones. Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. Extra
columns, clashing names among them, are ignored. An empty table has no conversation and gives no row.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, shuffle_partitions, stored, tidy

LOCAL = 200_000  # turns of a local bucket
FREQUENT_SHARE = 1000
MOST_SENT = 1_000_000  # rows of a few numbers that are broadcast at most
PIECE_CHARS = 64_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

CHAINS = "conv long, first long, last long, n_convs long, parent_conv long, n_children long, leaves long, below long, words array<long>, ends string"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t-\r]+", -1), lambda w: w != ""))


def turn_rows(df: DataFrame) -> DataFrame:
    """conv_id, turn, a digest of role and text, words of the text (a written table); texts stay behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words_in(text).cast("long").alias("words"))
    return stored(rows.filter("conv_id is not null"), "turns")


def encoded(turns: DataFrame) -> DataFrame:
    """Turns with the dictionary's number in the digest's place: conv_id, turn, digest, id, words."""
    counted = turns.groupBy("digest").agg(F.count("*").alias("n"))
    book = stored(counted.withColumn("id", F.monotonically_increasing_id()), "dictionary")  # numbers stay as they are written
    total = turns.count()
    often = book.filter(F.col("n") > max(1, total // FREQUENT_SHARE)).select("digest", F.col("id").alias("often"))  # under FREQUENT_SHARE rows
    known = turns.join(F.broadcast(often), "digest", "left")
    rest = known.filter("often is null").drop("often").join(book.select("digest", "id"), "digest")
    return rest.select("conv_id", "turn", "digest", "id", "words").unionByName(known.filter("often is not null").select("conv_id", "turn", "digest", F.col("often").alias("id"), "words"))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, t: the numbers and words of its turns in order (a written table)."""
    one = F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "words")))  # the turns of one conversation
    return stored(rows.groupBy("conv_id").agg(one.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["id"], x["words"])).alias("t")), "conversations")


def rebuilt(convs: DataFrame, block: int = 20, parts: int = 4) -> DataFrame:
    """conv_id, seq (numbers of turns), words: every conversation put together anew (a written table)."""
    h = crc_mod("conv_id", parts).cast("int")
    c = convs.select("conv_id", "t", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("source"))
    head = convs.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("source"), F.slice("t", 1, parts - 1).alias("lead"))  # no more than parts - 1 turns are taken
    none = F.array().cast("array<struct<id:bigint,words:bigint>>")
    own = F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))
    both = c.join(head, "source", "left").select("conv_id", F.concat(F.slice(F.coalesce("lead", none), F.lit(1), F.col("h")), own).alias("t"))
    return stored(both.select("conv_id", F.col("t.id").alias("seq"), F.col("t.words").alias("words")), "rebuilt")


def _pieces(batches):
    """Ids in order as comma-joined pieces of one key: key, first id, piece."""
    key, first, held, size = None, None, [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)], pa.string())], names=["key", "first", "piece"])

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (k != key or size > PIECE_CHARS):
                yield out()
                held, size = [], 0
            if not held:
                key, first = k, c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield out()


def _hashed(batches):
    key, h = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends"])

    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if h is not None:
                    yield out()
                key, h = k, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
    if h is not None:
        yield out()


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences (a written table): conv (smallest member), n, seq, words, ends (hash of all members)."""
    n = shuffle_partitions(convs.sparkSession)
    keyed = convs.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("seq").cast("array<string>"), ","), 256)))
    one = keyed.groupBy("key").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("seq").alias("seq"), F.first("words").alias("words"))
    ranged = keyed.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranged.mapInArrow(tidy(_pieces), "key binary, first long, piece string")
    ends = pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(tidy(_hashed), "key binary, ends string")
    return stored(one.join(ends, "key").drop("key"), "sequences")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table that is broadcast only if its counted rows are few."""
    return F.broadcast(df) if rows <= MOST_SENT else df


def _chain_rows(chains: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chains, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CHAINS.split(", ")])


def finished(items: list[tuple], depth: int, parent: int) -> list[list]:
    """The subtree of sequences that share their first depth turns, as chains of nodes: multikey quicksort.

    items: (conv, n, seq, words, ends). A chain is a list [conv, first depth, last depth, n, parent's conv,
    children, leaves, saved tokens below its last node, words, ends]; the first one is the top.
    """
    chains, above = [], []
    todo = [(items, depth - 1, parent, -1)]  # items below one node, the turn that parts them, that node
    while todo:
        some, d, up, at = todo.pop()
        if len(some) == 1:  # alone: the rest of the sequence is one chain
            conv, n, seq, words, ends = some[0]
            chains.append([conv, d + 1, len(seq), n, up, 0, 0, 0, words[d:].tolist(), ends])
            above.append(at)
            continue
        x = some[len(some) // 2][2][d]
        less, same, more = [], [], []
        for item in some:
            y = item[2][d]
            (same if y == x else less if y < x else more).append(item)
        todo += [(part, d, up, at) for part in (less, more) if part]
        # the equal ones are a node; turns that all share are passed over in one chain
        lead, last = same[0][2], d + 1
        stop = min(len(i[2]) for i in same)
        for i in same[1:]:
            differs = np.flatnonzero(lead[last:stop] != i[2][last:stop])
            stop = last + int(differs[0]) if len(differs) else stop
        last = stop
        done = [i for i in same if len(i[2]) == last]  # one at most, as sequences are distinct
        conv = min(i[0] for i in same)
        chains.append([conv, d + 1, last, sum(i[1] for i in same), up, 0, 0, 0, same[0][3][d:last].tolist(), done[0][4] if done else None])
        above.append(at)
        rest = [i for i in same if len(i[2]) > last]
        if rest:
            todo.append((rest, last, conv, len(chains) - 1))
    for i in reversed(range(len(chains))):  # children come after their parents
        c = chains[i]
        if c[5] == 0:
            c[6] = 1
        if above[i] >= 0:
            top = chains[above[i]]
            top[5] += 1
            top[6] += c[6]
            top[7] += c[7] + (c[3] - 1) * sum(c[8])
    return chains


def _local(batches):
    """Rows of local buckets, one bucket after another: their chains."""
    bucket, items = None, []

    def out():
        return finished(items, bucket[1] + 1, bucket[0])

    chains: list = []
    for batch in batches:
        cols = [batch.column(i) for i in range(8)]
        pc, pd, digit, conv, n, ends = (c.to_pylist() for c in (*cols[:5], cols[7]))
        flat = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in cols[5:7]]
        for i, key in enumerate(zip(pc, pd, digit, strict=True)):
            if key != bucket:
                if items:
                    chains += out()
                    items = []
                    if len(chains) > 5000:
                        yield _chain_rows(chains)
                        chains = []
                bucket = key
            seq, words = (v[o[i] : o[i + 1]] for o, v in flat)
            items.append((conv[i], n[i], seq, words, ends[i]))
    if items:
        chains += out()
    if chains:
        yield _chain_rows(chains)


def _nodes(batches):
    """Chains as nodes, from the bottom: what lies below grows by each node's own saving."""
    names = [x.split()[0] for x in NODES.split(", ")]
    for batch in batches:
        conv, first, last, n, parent, children, leaves, below = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
        words = batch.column(8)
        ends = batch.column(9).to_pylist()
        parent = batch.column(4).to_pylist()
        out: list[list] = [[] for _ in names]
        starts, flat = words.offsets.to_numpy(), words.values.to_numpy()
        for i in range(batch.num_rows):
            own = (n[i] - 1) * flat[starts[i] : starts[i + 1]]
            size = int(last[i] - first[i] + 1)
            saved = below[i] + np.cumsum(own[::-1])[::-1]
            if size > len(own):  # the root has no text
                saved = np.concatenate([[saved[0] if len(own) else below[i]], saved])
            cols = (
                [conv[i]] * size, range(first[i], last[i] + 1), [parent[i]] + [conv[i]] * (size - 1), [n[i]] * size, [1] * (size - 1) + [children[i]], [leaves[i]] * size,
                saved.tolist(), [EMPTY_SHA] * (size - 1) + [ends[i] if ends[i] is not None else EMPTY_SHA],
            )
            for c, v in zip(out, cols, strict=True):
                c.extend(v)
        kinds = [pa.int64()] * 7 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def trie(seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie of distinct sequences (conv, n, seq, words, ends)."""
    spark = seqs.sparkSession
    rows = seqs.select("conv", "n", "seq", "words", "ends", F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("d"))
    finish, rounds, parents = [], [], []
    while True:
        # what a bucket's sequences share: up to where its smallest and its largest one part
        agg = rows.groupBy("b", "d").agg(F.min("seq").alias("x"), F.max("seq").alias("y"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv"), F.count("*").alias("rows"))
        shared = F.coalesce(F.array_position(F.zip_with("x", "y", lambda p, q: p.eqNullSafe(q)), False), F.lit(0))
        least = F.least(F.size("x"), F.size("y")).cast("long")
        tops = stored(agg.select("b", "d", F.when(shared > 0, shared - 1).otherwise(least).alias("l"), "n_convs", "conv", "rows"), "tops")
        n_tops = tops.count()
        if not n_tops:
            break
        cut = rows.join(small(tops.select("b", "d", "l", F.col("conv").alias("top")), n_tops), ["b", "d"])
        cut = cut.withColumn("digit", F.get("seq", F.col("l").cast("int")))
        kids = stored(cut.groupBy("b", "d", "digit").agg(F.sum(F.size("seq") - F.col("d") + 1).alias("turns"), F.min("conv").alias("kid"), F.count("*").alias("rows")), "kids")
        large = kids.filter((F.col("turns") > local) & (F.col("rows") > 1) & F.col("digit").isNotNull()).select("b", "d", "digit", "kid")
        n_large = large.count()
        first = cut.filter("conv = top").select("b", "d", F.slice("words", F.col("d").cast("int") + F.when(F.col("d") == 0, 1).otherwise(0), F.greatest(F.col("l") - F.col("d") + F.when(F.col("d") == 0, 0).otherwise(1), F.lit(0)).cast("int")).alias("words"))
        last = cut.filter("digit is null").select("b", "d", F.col("ends").alias("ends"))
        children = kids.filter("digit is not null").groupBy("b", "d").agg(F.count("*").alias("n_children"))
        chain = tops.join(first, ["b", "d"]).join(last, ["b", "d"], "left").join(children, ["b", "d"], "left")
        rounds.append(stored(chain.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "chains"))
        on = cut.filter("digit is not null").join(small(large, n_large), ["b", "d", "digit"], "left")
        dealt = stored(on.select("conv", "n", "seq", "words", "ends", F.col("top").alias("pconv"), F.col("l").alias("pdepth"), "digit", "kid"), "dealt")
        finish.append(dealt.filter("kid is null").drop("kid"))
        if not n_large:
            break
        rows = dealt.filter("kid is not null").select("conv", "n", "seq", "words", "ends", F.col("kid").alias("b"), (F.col("pdepth") + 1).alias("d"))
        parents.append(large.join(tops.select("b", "d", "l", "conv"), ["b", "d"]).select(F.col("kid").alias("b"), (F.col("l") + 1).alias("d"), F.col("conv").alias("pconv"), F.col("l").alias("pdepth")))
    if not rounds:
        return spark.createDataFrame([], NODES)

    below = finish[0]
    for more in finish[1:]:
        below = below.unionByName(more)
    met = below.select("pconv", "pdepth", "digit", "conv", "n", "seq", "words", "ends").repartition(shuffle_partitions(spark), "pconv", "pdepth", "digit").sortWithinPartitions("pconv", "pdepth", "digit", "conv")
    chains = stored(met.mapInArrow(tidy(_local), CHAINS), "local")
    own = (F.col("n_convs") - 1) * F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w)
    # a bucket's top is the chain whose parent is a large bucket's last node
    tops = rounds[0].select("conv", F.col("l").alias("depth"))
    for r in rounds[1:]:
        tops = tops.unionByName(r.select("conv", F.col("l").alias("depth")))
    sums = chains.select(F.col("parent_conv").alias("conv"), (F.col("first") - 1).alias("depth"), F.col("leaves"), (F.col("below") + own).alias("saved"))
    sums = stored(sums.groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).join(tops, ["conv", "depth"], "left_semi"), "sums")
    upper, carried = [], None
    for i in reversed(range(len(rounds))):
        r = rounds[i].join(sums.select("conv", F.col("depth").alias("l"), "leaves", "saved"), ["conv", "l"], "left")
        if carried is not None:
            r = r.join(carried, ["conv", "l"], "left")
        else:
            r = r.withColumns({"more_leaves": F.lit(None).cast("long"), "more_saved": F.lit(None).cast("long")})
        zero = F.lit(0).cast("long")
        leaves = F.coalesce("leaves", zero) + F.coalesce("more_leaves", zero)
        r = r.withColumn("leaves", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(leaves)).withColumn("below", F.coalesce("saved", zero) + F.coalesce("more_saved", zero))
        if i:
            r = r.join(parents[i - 1], ["b", "d"])
        else:
            r = r.withColumns({"pconv": F.lit(None).cast("long"), "pdepth": F.lit(None).cast("long")})
        r = stored(r, "upper")
        upper.append(r.select("conv", F.col("d").alias("first"), F.col("l").alias("last"), "n_convs", F.col("pconv").alias("parent_conv"), "n_children", "leaves", "below", "words", "ends"))
        carried = r.groupBy(F.col("pconv").alias("conv"), F.col("pdepth").alias("l")).agg(F.sum("leaves").alias("more_leaves"), F.sum(F.col("below") + own).alias("more_saved"))
    for u in upper:
        chains = chains.unionByName(u)
    return chains.select(*[x.split()[0] for x in CHAINS.split(", ")]).mapInArrow(tidy(_nodes), NODES)


def conversation_trie(df: DataFrame, block: int = 20, parts: int = 4, local: int = LOCAL) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations (conv_id, turn, role, text)."""
    turns = turn_rows(df)
    convs = conversations(encoded(turns))
    discard(turns)
    whole = rebuilt(convs, block, parts)
    discard(convs)
    seqs = sequences(whole)
    discard(whole)
    return trie(seqs, local)
