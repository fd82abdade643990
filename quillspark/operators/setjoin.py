"""Similarity join of sets by Jaccard, exactly: size steps, prefixes, positions, signatures.

This is the join of two tables; sets of one table, of which nearly all share some elements of their prefixes, are joined
block by block (blockjoin). A set is the ordered array of its elements' codes, the rarest first (by how many sets hold them, then code).
With s the smaller of two sets and l the larger, a pair that reaches t shares at least
a = ceil(t / (1 + t) * (|s| + |l|)) elements, and so

  prefixes    one of the first |s| - ceil(2t / (1 + t) |s|) + 1 of s and the first |l| - ceil(t |l|) + 1 of l
  size steps  |l| <= |s| / t: sizes fall into steps of that ratio, and a set meets its own and the next step
  positions   of the first shared one, at places i and j, at least a - 1 more have to follow on both sides
  signatures  one bit for each of 512 classes of codes, whether a set holds an odd number of it: the bits in
              which two sets differ are no more than the elements in which they do, |s| + |l| - 2 a at most

Sets meet by the key (code, step); the last two decide there, by arrays over all pairs of some keys at once.
What is left is counted on the sets themselves. Frequent codes are in no prefix of a set that holds rare ones;
keys that many sets share are dealt over a grid of tasks. Tasks hold a bounded number of elements and pairs at once.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blockjoin import block_pairs
from .tables import scratch, tune

WORDS = 8  # 64-bit words of a signature
MOST_CODES = 1_000_000  # rows of few numbers that are sent to all tasks
PART, AT_ONCE = 20_000, 250_000  # rows of either kind of one key, and pairs of them, that are looked at together
ELEMENTS = 500_000  # of some sets that a task holds as arrays
EPS = 1e-9


def runs(sizes: np.ndarray, most: int):
    """Bounds of runs of rows of most elements in all, of one row at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def coded_ngrams(rows: DataFrame, id_col: str, form: Column, side: int = 0, n: int = 3) -> DataFrame:
    """side, id, codes: the distinct runs of n characters of a text, as numbers (21 bits a character); n at most 3.
    And mark, a 128-bit hash of them: equal for equal sets."""
    tune(rows.sparkSession)

    def run(batches):
        for whole in batches:
            for lo, hi in runs(pc.fill_null(pc.utf8_length(whole.column(2)), 0).to_numpy(), ELEMENTS):
                yield of(whole.slice(lo, hi - lo))

    def of(batch):
        parts = []
        for text in batch.column(2).to_pylist():
            c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            m = max(0, len(c) - n + 1)
            code = np.zeros(m, np.int64)
            for k in range(n):
                code = (code << 21) | c[k : k + m]
            parts.append(np.unique(code))
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        codes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        marks = pa.array([blake2b(p.tobytes(), digest_size=16).digest() for p in parts], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, marks], names=["side", "id", "codes", "mark"])

    own = rows.select(F.lit(side).alias("side"), F.col(id_col).cast("long").alias("id"), form.alias("form"))
    return own.mapInArrow(run, "side int, id long, codes array<long>, mark binary").filter(F.size("codes") > 0)


def _with_signature(side: pa.Array, ids: pa.Array, offsets: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    n = np.diff(offsets)
    x = flat.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    bit = ((x >> np.uint64(40)) % np.uint64(64 * WORDS)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(n)), n) * (64 * WORDS) + bit, minlength=len(n) * 64 * WORDS) % 2
    words = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1).view("<i8").reshape(len(n), WORDS)
    codes = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([side, ids, codes, pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS))], names=["side", "id", "codes", "n", *(f"s{i}" for i in range(WORDS))])


def ordered(sets: DataFrame, written: bool = False) -> DataFrame:
    """The written table side, id, codes (rarest first), n and the signature's words of (side, id, codes); written:
    sets are read from a table, not computed, and need no copy.

    Up to MOST_CODES different codes their numbers go to every task (16 bytes each) and codes become their places in
    the order; beyond, elements meet the numbers in a join."""
    sets = sets.select("side", "id", "codes")
    sets = sets if written else scratch(sets)
    one = sets.select("side", "id", F.explode("codes").alias("code"))
    often = scratch(one.groupBy("code").agg(F.count("*").alias("df")))
    few = often.count() <= MOST_CODES
    held = None
    if few:
        table = often.orderBy("code").toArrow()
        known, df = table.column("code").to_numpy(), table.column("df").to_numpy()
        place = np.empty(len(known), np.int64)
        place[np.lexsort((known, df))] = np.arange(len(known))
        held = sets.sparkSession.sparkContext.broadcast((known, place))
    else:
        rare_first = F.sort_array(F.collect_list(F.struct("df", "code")))  # the elements of one set
        sets = one.join(often, "code").groupBy("side", "id").agg(rare_first.alias("l")).select("side", "id", F.col("l.code").alias("codes"))

    def run(batches):
        for whole in batches:
            for lo, hi in runs(np.diff(whole.column(2).offsets.to_numpy()), ELEMENTS):
                yield of(whole.slice(lo, hi - lo))

    def of(batch):
        codes = batch.column(2)
        offsets, flat = codes.offsets.to_numpy(), codes.values.to_numpy()
        flat = flat[offsets[0] : offsets[-1]]
        if held is not None:
            known, place = held.value
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            flat = place[np.searchsorted(known, flat)]
            flat = flat[np.lexsort((flat, owner))]
        return _with_signature(batch.column(0), batch.column(1), offsets, flat)

    return scratch(sets.mapInArrow(run, "side int, id long, codes array<long>, n int, " + ", ".join(f"s{i} long" for i in range(WORDS))))


def _met(threshold: float, two_sided: bool):
    """Rows (key, side, id, n, at, words) sorted by key with the smaller sets' (kind 0) first: pairs that pass all filters."""

    def filtered(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray):
        n, side, ids, at, words = c["n"], c["side"], c["id"], c["at"], c["words"]
        first = (side[x] < side[y]) if two_sided else (ids[x] < ids[y])  # of equal sizes one is the smaller
        if two_sided:  # of two sides the key of order is (side, id), and sides differ
            x, y, first = (z[side[x] != side[y]] for z in (x, y, first))
        good = ((n[x] < n[y]) | ((n[x] == n[y]) & first)) & (n[x] >= threshold * n[y] - EPS)
        x, y = x[good], y[good]
        total = n[x] + n[y]
        least = np.ceil(threshold / (1 + threshold) * total - EPS).astype(np.int64)
        good = np.minimum(n[x] - at[x], n[y] - at[y]) >= least  # places count from 0: the shared one is in it
        x, y, room = x[good], y[good], (total - 2 * least)[good]
        good = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= room
        return x[good], y[good]

    def run(batches):
        for part in whole_keys(batches):
            group, kind = part["group"], part["kind"]
            small, large = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            begin, stop = np.searchsorted(group[large], group[small]), np.searchsorted(group[large], group[small], "right")
            count = stop - begin
            small, begin, count = small[count > 0], begin[count > 0], count[count > 0]
            found, held = [], 0
            for lo, hi in runs(count, AT_ONCE):
                c = count[lo:hi]
                place = np.repeat(begin[lo:hi] - np.cumsum(c) + c, c) + np.arange(c.sum())
                x, y = filtered(part, np.repeat(small[lo:hi], c), large[place])
                a, b = part["id"][x], part["id"][y]
                turned = (part["side"][x] == 1) if two_sided else (a > b)
                found.append((np.where(turned, b, a), np.where(turned, a, b)))
                held += len(a)
                if held > AT_ONCE:  # the rest of one key may be as many again
                    yield _once(found)
                    found, held = [], 0
            if found:
                yield _once(found)

    return run


def _once(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(z) for z in zip(*found, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def whole_keys(batches):
    """Columns of whole keys, some batches at once; a key has at most PART rows of either kind."""
    held: list = []

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        c = {name: table.column(name).to_numpy() for name in ("code", "step", "px", "py", "kind", "side", "id", "n", "at")}
        new = np.zeros(table.num_rows, bool)
        for name in ("code", "step", "px", "py"):
            new |= np.diff(c[name], prepend=c[name][:1]) != 0
        c["group"], c["n"], c["at"] = np.cumsum(new), c["n"].astype(np.int64), c["at"].astype(np.int64)
        c["words"] = np.stack([table.column(f"s{i}").to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)  # bits of signed numbers would be counted of their amounts
        return c

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < 50_000:
            continue
        table = pa.Table.from_batches(held)
        c = columns(table)
        last = int(np.searchsorted(c["group"], c["group"][-1]))
        if last:
            yield {k: v[:last] for k, v in c.items()}
            held = table.slice(last).to_batches()
    if held:
        yield columns(pa.Table.from_batches(held))


def similar_pairs(sets: DataFrame, threshold: float, two_sided: bool = False) -> DataFrame:
    """a, b, jaccard of all pairs of ordered() sets with Jaccard of at least threshold: of ids a < b, or of side 0
    and side 1."""
    if not two_sided:
        return block_pairs(sets.filter("side = 0"), threshold)
    step = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + EPS).cast("int")
    n, t, own = F.col("n"), threshold, ["side", "id", "n", *(f"s{i}" for i in range(WORDS))]
    short = F.slice("codes", F.lit(1), (n - F.ceil(F.lit(2 * t / (1 + t)) * n - EPS) + 1).cast("int"))
    long = F.slice("codes", F.lit(1), (n - F.ceil(F.lit(t) * n - EPS) + 1).cast("int"))
    small = sets.select(*own, step(n).alias("step"), F.posexplode(short).alias("at", "code"))
    large = sets.select(*own, "codes", F.explode(F.array(step(n), step(n) - 1)).alias("step")).select(*own, "step", F.posexplode(long).alias("at", "code"))
    # keys of many sets become a grid of parts, each of at most about PART rows of either kind
    key = ["code", "step"]
    sizes = small.groupBy(*key).agg(F.count("*").alias("c")).join(large.groupBy(*key).agg(F.count("*").alias("d")), key)
    hot = scratch(sizes.filter(F.greatest("c", "d") > PART).select(*key, F.ceil(F.col("c") / PART).cast("int").alias("nx"), F.ceil(F.col("d") / PART).cast("int").alias("ny")))
    n_hot = hot.count()
    zero = F.lit(0).alias
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= MOST_CODES else hot
        parts = lambda c: F.coalesce(c, F.lit(1))
        mine = lambda c: F.pmod(F.xxhash64("side", "id"), parts(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
        small = small.join(hot, key, "left").withColumn("px", mine(F.col("nx"))).withColumn("py", every(F.col("ny"))).drop("nx", "ny")
        large = large.join(hot, key, "left").withColumn("py", mine(F.col("ny"))).withColumn("px", every(F.col("nx"))).drop("nx", "ny")
    else:
        small, large = (d.select("*", zero("px"), zero("py")) for d in (small, large))
    at = [*key, "px", "py"]
    rows = small.withColumn("kind", F.lit(0)).unionByName(large.withColumn("kind", F.lit(1)))
    met = rows.repartition(*at).sortWithinPartitions(*at, "kind").mapInArrow(_met(threshold, True), "a long, b long")
    left = sets.filter("side = 0").select(F.col("id").alias("a"), F.col("codes").alias("ca"))
    right = sets.filter("side = 1").select(F.col("id").alias("b"), F.col("codes").alias("cb"))
    return met.distinct().join(left, "a").join(right, "b").mapInArrow(_counted(threshold), "a long, b long, jaccard double")


def _counted(threshold: float):
    def run(batches):
        for batch in batches:
            ca, cb = batch.column(batch.schema.get_field_index("ca")), batch.column(batch.schema.get_field_index("cb"))
            (oa, fa), (ob, fb) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (ca, cb))
            out = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                x, y = fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]]
                inter = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = inter / (len(x) + len(y) - inter)
            good = np.flatnonzero(out >= threshold)
            kept = batch.select(["a", "b"]).take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.round(out[good], 6))], names=["a", "b", "jaccard"])

    return run
