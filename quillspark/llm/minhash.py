"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds its distinct runs of `width` words (A-Z lower-cased; fewer words: the whole
sequence is its one shingle). One hash orders all shingles and the K smallest are its sketch.
Equal sets are one class. A class enters the inverted lists of its HEADS smallest values, one list
for each value and size step (sets whose sizes differ by more than the threshold cannot link). A pair
belongs to the list of the first value it shares; at the threshold a pair has more than APART unshared
values before it with probability 0.2^10. In a list, pairs are compared by the union of their sketches
(first the PROBE smallest values, then K), kept if the estimate is within 6 standard deviations of
the threshold, and confirmed on full sets: 100 * intersection >= percent * union, exactly.

Pairs within a list are not all emitted. The first round proposes a spanning forest of each list's
estimated links; those confirmed on their words join components. Lists with failed proposals are opened
again with full sets: pairs of different components are compared, best estimates first, unless joined
meanwhile, and only a forest of links leaves the task, again confirmed on words. So components are those
of all links. Hashes find and count shingles (64 bits; classes are told apart by 128); what links two
texts is that their words are equal, compared as such. Lists longer than BLOCK members (or BLOCK_SHINGLES
values) are split and their blocks meet two by two.

Texts that are null or hold no word link with nothing (component: their own id). Repeated rows are one
class. Rows of one id with different texts are judged each by its text and share the id's component; a
null id has component null, links with nothing and is kept. Ties: the smallest id stands for a group.
Extra columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, stored, tidy
from .words import Words, mix, run_hashes

K, HEADS, BLOCK, BLOCK_SHINGLES = 32, 10, 1024, 2_000_000
APART = 9  # values only one of two sets has before the first they share
PROBE, PROBE_LEAST = 12, 2  # a first look at so many values must find so many shared
DEVIATIONS = 6  # a pair is kept if its estimate is at most so many below the threshold
_PAD = 0xFFFFFFFF
MAX_WORDS = 300_000  # words a task keeps numbered between batches


def shingles(text: str | None, words: Words, width: int) -> tuple[np.ndarray, int]:
    """The ids of a text's words, A-Z lower-cased, and the width of its shingles: all words if they are fewer."""
    ids = words.numbers((text or "").encode().lower())
    return ids, min(width, len(ids))


def hashes(ids: np.ndarray, words: Words, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every shingle, another one for each seed."""
    if not width:
        return np.zeros(0, np.uint64)
    return mix(run_hashes(words.values(ids, seed), width, seed) + np.uint64(width))


def shingle_sets(texts: list[str], width: int, seed: int = 0, words: Words | None = None) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = Words() if words is None else words
    return [np.unique(hashes(ids, words, w, seed)) for ids, w in (shingles(t, words, width) for t in texts)]


class ShingleSet:
    """The distinct shingles of a text: their hashes in order, and a place of each for comparing words."""

    def __init__(self, ids: np.ndarray, words: Words, width: int):
        every = hashes(ids, words, width)
        by = np.argsort(every)
        h = every[by]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        self.ids, self.width, self.hash, self.at = ids, width, h[new], by[new]
        head = by[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else by
        self.sure = all(np.array_equal(ids[by + k], ids[head + k]) for k in range(width))  # equal hashes, equal words

    def shared(self, other: ShingleSet) -> int | None:
        """How many shingles both hold; None if hashes of different words are equal."""
        if not (self.sure and other.sure):
            return None
        if self.width != other.width:
            return 0
        at = np.searchsorted(other.hash, self.hash)
        hit = np.flatnonzero(other.hash[np.minimum(at, len(other.hash) - 1)] == self.hash) if len(other.hash) else at[:0]
        a, b = self.at[hit], other.at[at[hit]]
        same = all(np.array_equal(self.ids[a + k], other.ids[b + k]) for k in range(self.width))
        return len(hit) if same else None

    def plain(self) -> set[tuple]:
        return {tuple(self.ids[i : i + self.width].tolist()) for i in range(len(self.ids) - self.width + 1)} if self.width else set()


def linked(a: ShingleSet, b: ShingleSet, percent: int) -> bool:
    """Whether two texts link, decided on their words."""
    shared, union = a.shared(b), len(a.hash) + len(b.hash)
    if shared is None:
        left, right = a.plain(), b.plain()
        shared, union = len(left & right), len(left) + len(right)
    return shared > 0 and 100 * shared >= percent * (union - shared)


def _sketch(s: np.ndarray) -> np.ndarray:
    top = np.full(K, _PAD, "<u4")
    top[: min(K, len(s))] = (s[:K] >> np.uint64(32)).astype("<u4")
    return top


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs: a merge
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _sketches(width: int):
    def run(batches):
        words = Words()
        for batch in batches:
            n, heads, sketch, mark = [], [], [], []
            for t in batch.column(1).to_pylist():
                ids, w = shingles(t, words, width)
                own, at = np.unique(hashes(ids, words, w), return_index=True)
                other = hashes(ids, words, w, 1)[at]
                n.append(len(own))
                heads.append(own[:HEADS].view(np.int64))
                sketch.append(_sketch(own).tobytes())
                mark.append(xxhash.xxh3_128_digest(own.tobytes() + other.tobytes()))
            if len(words) > MAX_WORDS:
                words.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(sketch, pa.binary()), pa.array(heads, pa.list_(pa.int64()))],
                names=["id", "n", "mark", "sketch", "heads"],
            )

    return run


def _compare(percent: int, exact: bool):
    """Pairs of a batch of whole groups: a forest of estimated links, or with exact one of true links
    between components, each pair compared on its full sets unless already joined."""
    t = percent / 100

    def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shared among the smallest of the union, how many those are, and the first shared value."""
        k = a.shape[1]
        both = np.sort(np.concatenate([a, b], axis=1), axis=1)
        eq = np.zeros(both.shape, bool)
        eq[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
        rank = np.cumsum(~eq & (both != _PAD), axis=1)
        first = np.take_along_axis(both, eq.argmax(axis=1)[:, None], 1)[:, 0]
        return (eq & (rank <= k)).sum(axis=1), np.minimum(rank[:, -1], k), first

    def batch_pairs(group, key, ident, n, rank, side, comp, step_of, at_step, value, sketch, sets):
        size = len(group)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        end = np.repeat(np.append(starts[1:], size), np.diff(np.append(starts, size)))
        left = np.arange(size)
        found = []
        step, i = 1, left[left + 1 < end]
        wait_i, wait_j, held = [], [], 0

        def settle():
            a, b = np.concatenate(wait_i), np.concatenate(wait_j)
            for at in range(0, len(a), 20_000):
                x, y = a[at : at + 20_000], b[at : at + 20_000]
                hits, k, first = estimates(sketch[x, :PROBE], sketch[y, :PROBE])
                # a pair belongs to the list of the first value it shares
                good = (first == value[x]) & (hits >= np.minimum(PROBE_LEAST, np.ceil(t * k / 2)))
                x, y = x[good], y[good]
                hits, k, _ = estimates(sketch[x], sketch[y])
                est = hits / np.maximum(k, 1)
                good = est >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(k, 1)) - 1e-9
                found.append((x[good], y[good], est[good]))

        while len(i):
            j = i + step
            ok = (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])) & (rank[i] + rank[j] <= APART) & (np.maximum(step_of[i], step_of[j]) == at_step[i]) & (ident[i] != ident[j]) & (comp[i] != comp[j])
            ok &= (side[i] < 0) | (side[i] != side[j])
            wait_i.append(i[ok]), wait_j.append(j[ok])
            held += int(ok.sum())
            if held > 200_000:
                settle()
                wait_i, wait_j, held = [], [], 0
            step += 1
            i = i[i + step < end[i]]
        if wait_i:
            settle()
        if not found:
            return None
        x, y, est = (np.concatenate([f[k] for f in found]) for k in range(3))
        if not len(x):
            return None
        g = group[x]
        # within a group, rows of one component are joined from the start
        if exact:
            _, at = np.unique(np.stack([group, comp]), axis=1, return_inverse=True)
            at = at.ravel()
        else:
            at = np.arange(size)
        root = list(range(size))

        def top(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        keep = np.zeros(len(x), bool)
        order = np.argsort(-est, kind="stable")
        for e, i, j in zip(order.tolist(), x[order].tolist(), y[order].tolist(), strict=True):
            a, b = top(at[i]), top(at[j])
            if a != b and (not exact or _linked(sets[i], sets[j], percent)):
                root[a] = b
                keep[e] = True
        kinds, inv = np.unique(g, return_inverse=True)
        more = np.bincount(inv) > np.bincount(inv, keep)
        a, b = np.minimum(ident[x], ident[y])[keep], np.maximum(ident[x], ident[y])[keep]
        return pa.RecordBatch.from_arrays([pa.array(key[x][keep]), pa.array(a), pa.array(b), pa.array(more[inv][keep])], names=["key", "a", "b", "more"])

    def run(batches):
        carry, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            carry.append(batch)
            held += batch.num_rows
            if held < 10_000:
                continue
            whole = pa.Table.from_batches(carry).combine_chunks()
            g = whole.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                out = one(whole.slice(0, cut))
                if out is not None:
                    yield out
            carry = whole.slice(cut).to_batches()
            held = whole.num_rows - cut
        if held:
            out = one(pa.Table.from_batches(carry).combine_chunks())
            if out is not None:
                yield out

    def one(rows: pa.Table):
        cols = [rows.column(c).to_numpy() for c in ("g", "key", "id", "n", "rank", "side", "comp", "step", "at_step", "value")]
        raws = rows.column("sketch").to_pylist()
        sketch = np.frombuffer(b"".join(r[: 4 * K] for r in raws), "<u4").reshape(-1, K)
        return batch_pairs(*cols, sketch, [np.frombuffer(r, "<u8", offset=4 * K) for r in raws] if exact else None)

    return run


def _confirm(percent: int, width: int):
    def run(batches):
        words = Words()
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                (a, w), (b, v) = shingles(left, words, width), shingles(right, words, width)
                good.append(linked(ShingleSet(a, words, w), ShingleSet(b, words, v), percent))
            if len(words) > MAX_WORDS:
                words.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return run


def _full_sets(width: int, seed: int):
    """The sketch, then the whole set by hashes of the seed."""

    def run(batches):
        words = Words()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tops = [_sketch(s).tobytes() for s in shingle_sets(texts, width, 0, words)]
            sets = [s.tobytes() for s in shingle_sets(texts, width, seed, words)]
            if len(words) > MAX_WORDS:
                words.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a + b for a, b in zip(tops, sets, strict=True)], pa.binary())], names=["id", "sketch"])

    return run


def _proposals(lists: DataFrame, sketches: DataFrame, percent: int, comp: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Rows (key, a, b, more) of the lists; only: keys of lists to open again, with full sets for sketches."""
    if only is None:
        lists = lists.withColumn("comp", F.col("id"))
    else:
        lists = lists.join(only, "key", "left_semi").join(comp, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("component_id", "id")).drop("node", "component_id")
        mixed = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        lists = lists.join(mixed, "key", "left_semi")
    rows = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    rows = rows.withColumn("g", F.xxhash64("key", "lo", "hi"))
    rows = rows.withColumn("side", F.when(F.col("lo") == F.col("hi"), F.lit(-1)).otherwise(F.col("blk")))
    rows = rows.select("g", "key", "id", "n", "rank", "side", "comp", "step", "at_step", "value").join(sketches.hint("merge"), "id")
    rows = rows.repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(tidy(_compare(percent, only is not None)), "key long, a long, b long, more boolean")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest linked id, itself included), kept."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    all_rows = stored(rows.mapInArrow(tidy(_sketches(width)), "id long, n long, mark binary, sketch binary, heads array<long>"), "sketches")
    full = all_rows.filter("n > 0 and id is not null")
    classes = full.groupBy("mark").agg(F.min("id").alias("rep"))
    reps = full.join(classes.hint("merge"), "mark").filter("id = rep").dropDuplicates(["id", "mark"])
    # lists: small rows first; those of one member go before sketches are sent
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    heads = reps.select("id", "n", step.alias("step"), F.posexplode("heads").alias("rank", "value"))
    heads = heads.withColumn("at_step", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    heads = heads.select(F.xxhash64("value", "at_step").alias("key"), "id", "n", "rank", "step", "at_step", F.shiftrightunsigned("value", 32).alias("value"))
    seen = [F.count("*").alias("c"), F.max("n").alias("most"), F.min("n").alias("fewest"), F.min("rank").alias("r1"), F.max("rank").alias("r2"), F.max("step").alias("top")]
    # a pair is met in the list of its larger step, so a list without a set of its own step has none; most lists
    # hold two sets that share a common shingle by chance, and of those the sizes and ranks tell already
    near = (100 * F.col("fewest") >= percent * F.col("most")) & (F.col("r1") + F.col("r2") <= APART)
    counts = heads.groupBy("key", "at_step").agg(*seen).filter((F.col("c") > 1) & (F.col("top") == F.col("at_step")) & ((F.col("c") > 2) | near)).drop("at_step")
    lists = heads.join(counts.hint("merge"), "key").withColumn("nb", F.ceil(F.col("c") * F.greatest(F.lit(1 / BLOCK), F.col("most") / BLOCK_SHINGLES)).cast("int"))
    lists = stored(lists.select("key", "id", "n", "rank", "step", "at_step", "value", "nb", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("blk")), "lists")
    sketches = reps.select("id", "sketch")

    first = stored(_proposals(lists, sketches, percent), "round1")
    ends = first.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # neither side of these joins has a bound, so they are sort-merge joins at every size
    texts = stored(rows.join(ends.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs a, b with linked: whether their words say so (of rows of one id, whether any does)."""
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
        wide = pairs.select("a", "b").distinct().join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right")
        each = wide.mapInArrow(tidy(_confirm(percent, width)), "a long, b long, linked boolean")
        return stored(each.groupBy("a", "b").agg(F.max("linked").alias("linked")), name)

    tested = confirmed(first, "tested")
    spent = [lists, first, texts, tested]
    links = tested.filter("linked").select("a", "b")
    comp = stored(components(links), "components1")
    again = first.filter("more").join(tested.filter("not linked").select("a", "b"), ["a", "b"], "left_semi").select("key").distinct()
    for seed in itertools.count(1):  # once, but where hashes of different words have met
        sets = texts.mapInArrow(tidy(_full_sets(width, seed)), "id long, sketch binary")
        rest = stored(_proposals(lists, sets, percent, comp, again), f"round{1 + seed}")
        spent.append(rest)
        if not rest.head(1):
            break
        true = confirmed(rest, f"tested{1 + seed}")
        links = links.unionByName(true.filter("linked").select("a", "b"))
        spent += [true, comp]
        comp = stored(components(links), f"components{1 + seed}")
        false = true.filter("not linked").select("a", "b")
        if not false.head(1):
            break
        again = rest.join(false, ["a", "b"], "left_semi").select("key").distinct()
    discard(*spent)
    member = full.join(classes, "mark").select("id", "mark", "rep").distinct()
    found = member.join(comp, F.col("rep") == F.col("node"), "left").select("id", "mark", F.coalesce("component_id", "rep").alias("component_id"))
    out = all_rows.select("id", "n", "mark").join(found, ["id", "mark"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
