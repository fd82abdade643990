"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become pieces of at most capacity tokens: longer ones are cut from the end, so only the
first piece may be shorter. Full pieces are sequences of their own. The others are dealt by a hash to
regions of at most about REGION pieces (the region count grows with the data, the region does not), and each
region is evolved on ISLANDS islands:

  individual  a grouping of the region's pieces into sequences; the first is best-fit decreasing, the
              others are fitted with lengths shaken by a seed of the island
  crossover   whole well-filled sequences of one parent are injected into the other; sequences there
              that hold a piece twice are dissolved; displaced pieces are best-fitted, longest first:
              each piece into the sequence it fills best, or each sequence with the pieces that fill it
  migration   after each epoch an island's elite goes to the next island of its region (an exchange);
              the best grouping of a region at the end is taken

Fitness is the number of sequences, then the squared fill. Everything is seeded by region and island:
the result does not depend on task order. The log (level INFO) has the sequences of plain best fit, of
the evolved groupings and the bound.

Null and empty texts are the end id alone. Repeated rows are each packed; of pieces of equal length the
one of the smaller row number comes first. Extra columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import logging
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, stored, texts_of, trim
from .tokens import MAX_CHUNKS, ByteChunks, shared

REGION, ISLANDS, EPOCHS = 32768, 2, 2
POPULATION, GENERATIONS = 4, 8  # generations of an epoch
LOG = logging.getLogger(__name__)


def _pieces(tokenizer: str, end_id: int, capacity: int, with_ids: bool, table_chunks: int):
    def run(batches):
        table = shared(ByteChunks, tokenizer, table_chunks)
        tail = np.uint32(end_id).tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, raw in zip(batch.column(0).to_pylist(), table.encode(texts_of(batch)), strict=True):
                raw += tail
                total, start, piece = len(raw) // 4, 0, 0
                while start < total:
                    size = (total % capacity or capacity) if piece == 0 else capacity
                    part = raw[4 * start : 4 * (start + size)]
                    for c, v in zip(cols, (doc, piece, start, size, zlib.crc32(part), part), strict=True):
                        c.append(v)
                    start, piece = start + size, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if with_ids else 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)
            del cols
        trim()  # the table stays for the next task

    return run


class Bins:
    """Sequences: the items of each and the room it has left."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room = capacity, [], []

    def add(self, items: list[int], room: int) -> None:
        self.items.append(items)
        self.room.append(room)


def best_fit(order: list[int], sizes: list[int], bins: Bins) -> Bins:
    """Each item, in order, into the new sequence with the least sufficient room; a bit mask of rooms finds it."""
    open_ones: list[list[int]] = [[] for _ in range(bins.capacity + 1)]
    mask = 0
    for i in order:
        size = sizes[i]
        free = mask >> size
        if free:
            room = size + (free & -free).bit_length() - 1
            at = open_ones[room].pop()
            if not open_ones[room]:
                mask ^= 1 << room
            bins.items[at].append(i)
            bins.room[at] = left = room - size
        else:
            left, at = bins.capacity - size, len(bins.items)
            bins.add([i], left)
        open_ones[left].append(at)
        mask |= 1 << left
    return bins


def best_filled(order: list[int], sizes: list[int], bins: Bins, slack: int) -> Bins:
    """New sequences one by one: the largest item left, then again and again the item or the two items
    that fill the room exactly, or but for at most slack; failing that, the largest that goes in.

    Bit masks of the sizes left, upwards and downwards from the capacity, find such items at once."""
    capacity = bins.capacity
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in reversed(order):
        left[sizes[i]].append(i)
    up = sum(1 << s for s, items in enumerate(left) if items)
    down = sum(1 << (capacity - s) for s, items in enumerate(left) if items)
    while up:
        chosen, room, items = [up.bit_length() - 1], capacity, []
        while chosen:
            for s in chosen:
                items.append(left[s].pop())
                room -= s
                if not left[s]:
                    up ^= 1 << s
                    down ^= 1 << (capacity - s)
            least = (up & -up).bit_length() - 1
            chosen = []
            if not up or least > room:
                break
            for aim in range(room, max(least, room - slack) - 1, -1):
                if up >> aim & 1:
                    chosen = [aim]
                    break
                pairs = up & (down >> (capacity - aim)) & ((1 << aim) - 1)
                while pairs:
                    s = pairs.bit_length() - 1
                    if 2 * s != aim or len(left[s]) > 1:
                        chosen = [s, aim - s]
                        break
                    pairs ^= 1 << s
                if chosen:
                    break
            chosen = chosen or [(up & ((2 << room) - 1)).bit_length() - 1]
        bins.add(items, room)
    return bins


def fitness(bins: Bins) -> tuple[int, int]:
    """Smaller is better."""
    return len(bins.items), -sum((bins.capacity - r) ** 2 for r in bins.room)


def cross(giver: Bins, taker: Bins, sizes: list[int], rng: np.random.Generator) -> Bins:
    """Whole sequences of the giver's better-filled half go into the taker; sequences there that hold one of
    their pieces are dissolved, and most with room and some others too, so that displaced pieces find
    partners. Displaced pieces are best-fitted, longest first, by one of the two rules."""
    room = np.array(giver.room)
    some = np.argsort(room, kind="stable")[: max(1, len(room) // 2)]
    some = some[rng.random(len(some)) < rng.uniform(0.1, 0.9)].tolist()
    child, inside = Bins(giver.capacity), np.zeros(len(sizes), bool)
    child.items, child.room = [giver.items[b] for b in some], [giver.room[b] for b in some]
    if some:
        inside[np.concatenate(child.items)] = True
    flat = np.fromiter((i for items in taker.items for i in items), np.int64, len(sizes))
    owner = np.repeat(np.arange(len(taker.items)), [len(i) for i in taker.items])
    broken = (np.array(taker.room) > 0) & (rng.random(len(taker.items)) < 0.9)
    broken |= rng.random(len(taker.items)) < rng.uniform(0, 0.3)
    broken[owner[inside[flat]]] = True
    for b in np.flatnonzero(~broken).tolist():
        child.add(taker.items[b], taker.room[b])
    free = flat[broken[owner] & ~inside[flat]]
    order = free[np.argsort(-np.array(sizes)[free], kind="stable")].tolist()
    new = Bins(giver.capacity)
    new = best_fit(order, sizes, new) if rng.random() < 0.2 else best_filled(order, sizes, new, int(rng.integers(6)))
    child.items += new.items
    child.room += new.room
    return child


def plain_best_fit(sizes: list[int], capacity: int) -> Bins:
    return best_fit(np.argsort(-np.array(sizes), kind="stable").tolist(), sizes, Bins(capacity))


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[int]] = (), generations: int = GENERATIONS) -> list[int]:
    """The best grouping found, as the sequence number of each item; elites take part from the start."""
    rng = np.random.default_rng(seed)
    plain = np.array(sizes)
    bound = -(-int(plain.sum()) // capacity)
    people = []
    for numbers in elites:
        bins = Bins(capacity)
        by = np.argsort(numbers, kind="stable")
        cut = np.flatnonzero(np.diff(np.array(numbers)[by], prepend=-1))
        for items in np.split(by, cut[1:]):
            bins.add(items.tolist(), capacity - int(plain[items].sum()))
        people.append(bins)
    if not people:
        people.append(plain_best_fit(sizes, capacity))
    while len(people) < POPULATION:
        shaken = plain * (1 + 0.01 * len(people) * rng.standard_normal(len(plain)))
        order = np.argsort(-shaken, kind="stable").tolist()
        people.append(best_fit(order, sizes, Bins(capacity)) if rng.random() < 0.5 else best_filled(order, sizes, Bins(capacity), int(rng.integers(6))))
    people.sort(key=fitness)
    for _ in range(generations):
        if len(people[0].items) <= bound:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        people += [cross(people[x], people[y], sizes, rng) for x, y in ((a, b), (b, a))]
        people = sorted(people, key=fitness)[:POPULATION]
    number = np.empty(len(sizes), np.int64)
    number[np.concatenate(people[0].items)] = np.repeat(np.arange(len(people[0].items)), [len(x) for x in people[0].items])
    return number.tolist()


_STATE = "region int, island int, elite binary, bins int, fill double, plain int, bound int"


def _epoch(capacity: int, epoch: int):
    def run(items: pa.Table, state: pa.Table) -> pa.Table:
        release(None)  # without tokenizer tables
        rows = []
        if items.num_rows:
            region, island = items.column("region")[0].as_py(), items.column("island")[0].as_py()
            size, row = items.column("length").to_numpy(), items.column("row").to_numpy()
            sizes = size[np.lexsort((row, -size))].tolist()
            elites = [np.frombuffer(e, "<i4").tolist() for e in state.column("elite").to_pylist()]
            best = evolve(sizes, capacity, (region * 64 + island) * 64 + epoch, elites)
            fill = np.bincount(best, weights=sizes)
            plain = len(plain_best_fit(sizes, capacity).items)
            rows.append((region, island, np.array(best, "<i4").tobytes(), len(fill), float((fill * fill).sum()), plain, -(-sum(sizes) // capacity)))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["region", "island", "elite", "bins", "fill", "plain", "bound"])

    return run


def _placed(items: pa.Table, state: pa.Table) -> pa.Table:
    release(None)
    size, row = items.column("length").to_numpy(), items.column("row").to_numpy()
    order = np.lexsort((row, -size))
    best = np.frombuffer(state.column("elite")[0].as_py(), "<i4") if len(order) else np.zeros(0, np.int64)
    by = np.argsort(best, kind="stable")
    run = np.cumsum(size[order][by]) - size[order][by]
    first = np.concatenate([[True], best[by][1:] != best[by][:-1]]) if len(by) else np.zeros(0, bool)
    offset = run - run[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))] if len(by) else run
    region = items.column("region")[0].as_py() if len(order) else 0
    seq = ((np.int64(region) << 32) + best[by]) << 1
    return pa.table([pa.array(row[order][by]), pa.array(seq.astype(np.int64)), pa.array(offset.astype(np.int64))], names=["row", "sequence_id", "offset"])


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """row, sequence_id and offset of pieces (row long, length long), each of at most capacity."""
    part = pieces.filter(F.col("length") < capacity)
    regions = max(1, -(-part.count() // REGION))
    items = part.select(F.pmod(F.xxhash64("row"), F.lit(regions)).cast("int").alias("region"), "row", "length")
    spread = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    state = None
    for epoch in range(EPOCHS):
        coming = pieces.sparkSession.createDataFrame([], _STATE)
        if state is not None:  # the elite of each island goes to the next one and stays at home
            moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
            coming = state.unionByName(moved)
        old, state = state, stored(spread.groupBy("region", "island").cogroup(coming.groupBy("region", "island")).applyInArrow(_epoch(capacity, epoch), _STATE), f"epoch{epoch}")
        if old is not None:
            discard(old)
    rank = F.struct(-F.col("bins"), "fill", -F.col("island"))
    best = state.groupBy("region").agg(F.max_by("elite", rank).alias("elite"), F.min("bins").alias("bins"), F.first("plain").alias("plain"), F.first("bound").alias("bound"))
    if LOG.isEnabledFor(logging.INFO):
        sums = best.agg(F.count("*"), F.sum("plain"), F.sum("bins"), F.sum("bound")).first()
        LOG.info("%s regions: best fit %s sequences, evolved %s, bound %s", *sums)
    best = best.select("region", "elite")
    placed = items.groupBy("region").cogroup(best.groupBy("region")).applyInArrow(_placed, "row long, sequence_id long, offset long")
    full = pieces.filter(F.col("length") >= capacity)
    return placed.unionByName(full.select("row", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", table_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids as bytes).

    table_chunks bounds the tokenizer table of each Python worker (about 200 bytes a chunk): it changes
    how often a word is segmented again, never the result."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    pieces = stored(rows.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids, table_chunks), schema).withColumn("row", F.monotonically_increasing_id()), "pieces")
    out = pieces.join(assign(pieces.select("row", "length"), capacity), "row").drop("row")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from pack(..., with_ids=True)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    @F.pandas_udf("array<int>")
    def whole(parts):
        return parts.map(lambda ps: np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").astype(np.int32))

    return parts.select("sequence_id", whole("parts").alias("ids"))
