"""Similarity join of sets by Jaccard, exactly, block against block: for sets of frequent elements, where shared rare ones tell little.

Sets are dealt by their size into blocks, and a task gets one pair of blocks whose sizes can reach the threshold t: it
holds the first block and reads the second. A set travels once for each partner of its block, as bytes, and all else is
done where the two blocks are; no pair is shuffled. Pairs pass

  sizes       |s| >= t |l|
  signatures  one bit for each class of elements, whether a set holds an odd number of it, in as many classes as the sets
              are large: bits in which two sets differ are at most (1 - t) / (1 + t) * (|s| + |l|)
  counts      the most frequent elements of the block are bits, the others a list; what both share is counted

The number of blocks stays until a block would hold more than HELD elements, so the shuffle grows with the sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
BLOCKS, SETS = 16, 2_000  # blocks of a table, and sets of a block at least
HELD = 48_000_000  # elements of a block at most, if no single size has more in each of MOST_PARTS parts
MOST_PARTS = 4096
LINES, CELLS = 256, 1 << 18  # sets that meet a block together, and pairs that are looked at at once
HEAD = 4096  # most frequent elements of a block that are bits
MARKS = 1 << 22  # marks of listed elements at once
PIECE = 1 << 20  # elements of some sets at once
MOST_WORDS = 256  # 64-bit words of a signature
COMPACT = 1 << 16  # codes below are written as their gaps


def _deal(sizes: list[tuple[int, int]], blocks: int, least: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Bounds (smallest, largest size) of blocks of about equal weight, and for each size its first block and how many
    it is dealt over. sizes: (size, count), ascending."""
    weight = lambda n, c: c * (200 + n)  # noqa: E731  work grows with the sets and with their elements
    n_sets, elements = sum(c for _, c in sizes), sum(n * c for n, c in sizes)
    goal = sum(weight(*x) for x in sizes) / max(1, min(blocks, -(-n_sets // least)), elements / HELD)
    bounds, place, now = [], {}, 0.0
    for n, c in sizes:
        parts = min(MOST_PARTS, round(weight(n, c) / goal))
        if parts > 1:  # a size of its own blocks
            place[n], now = (len(bounds), parts), 0.0
            bounds += [(n, n)] * parts
            continue
        if not bounds or now == 0 or now + weight(n, c) > goal * 1.2:
            bounds.append((n, n))
            now = 0.0
        bounds[-1] = (bounds[-1][0], n)
        place[n] = (len(bounds) - 1, 1)
        now += weight(n, c)
    return bounds, place


def _packed(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ascending codes and where each set begins. width 1: gaps, 255 for each 255 that a gap still has to go."""
    if width > 1:
        return flat.astype(f"<i{width}").view(np.uint8), offsets * width
    gap = np.diff(flat, prepend=0)
    first = offsets[:-1][np.diff(offsets) > 0]
    gap[first] = flat[first]
    extra = gap // 255
    ends = np.cumsum(extra + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gap % 255
    return out, np.concatenate([[0], ends])[offsets]


def _unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and offsets of the sets of a binary column."""
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if width > 1:
        return raw.view(f"<i{width}"), at // width
    ends = np.flatnonzero(raw != 255)
    sums = np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])
    offsets = np.searchsorted(ends, at)  # a set's bytes end with one of a code
    return (sums[ends + 1] - np.repeat(sums[at[:-1]], np.diff(offsets))).astype(np.int32), offsets


def _taken(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of some rows one after another, and how many each has."""
    size = offsets[rows + 1] - offsets[rows]
    return flat[np.repeat(offsets[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())], size


def _pieces(offsets: np.ndarray, most: int):
    """Bounds of runs of at most so many sets and about PIECE elements, of one set at least."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = min(lo + most, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1))
        yield lo, hi
        lo = hi


def _words(size: int) -> int:
    """Words of a signature of sets of this size: a power of two."""
    return min(MOST_WORDS, 1 << max(2, int(np.ceil(np.log2(max(1, size * 0.75 / 64))))))


def signatures(flat: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """words x sets: bits of the classes of which a set holds an odd number."""
    out = np.empty((words, len(offsets) - 1), np.uint64)
    for lo, hi in _pieces(offsets, max(1, (1 << 20) // (64 * words))):
        x = flat[offsets[lo] : offsets[hi]].astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bit = ((x >> np.uint64(40)) & np.uint64(64 * words - 1)).astype(np.int64)
        k = hi - lo
        odd = np.bincount(np.repeat(np.arange(k), np.diff(offsets[lo : hi + 1])) * (64 * words) + bit, minlength=k * 64 * words) & 1
        out[:, lo:hi] = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1).view(np.uint64).reshape(k, words).T
    return out


def _folded(signature: np.ndarray, words: int) -> np.ndarray:
    """The signature in fewer classes."""
    while len(signature) > words:
        half = len(signature) // 2
        signature = signature[:half] ^ signature[half:]
    return np.ascontiguousarray(signature)


class _Block:
    """Sets that a task holds, in ascending size; meet() gives the pairs with others."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, flat: np.ndarray, offsets: np.ndarray, threshold: float, ordered: bool):
        self.ids, self.n, self.threshold, self.ordered = ids, n, threshold, ordered
        self.signature = {(w := _words(int(n[-1]))): signatures(flat, offsets, w)}
        self.most = w
        self._number(flat)
        self.bits, self.tail, self.ends = self._split(flat, offsets)

    def _number(self, flat: np.ndarray) -> None:
        """Own numbers of the block's elements, the most frequent first."""
        if len(flat) and flat.min() >= 0 and flat.max() < MARKS:
            count = np.zeros(int(flat.max()) + 1, np.int64)
            for lo in range(0, len(flat), PIECE):
                count += np.bincount(flat[lo : lo + PIECE], minlength=len(count))
            self.known, order = None, np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
            self.place = np.full(len(count) + 1, -1, np.int32)  # the last stands for larger codes
        else:
            self.known, count = np.unique(flat, return_counts=True)
            order = np.argsort(-count, kind="stable")
            self.place = np.full(len(count) + 1, -1, np.int32)
        self.place[order] = np.arange(len(order))
        self.listed = max(1, len(order) - HEAD)

    def _split(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of the frequent elements, numbers of the others and their offsets; elements that the block lacks go."""
        bits, tail, left = np.empty((len(offsets) - 1, HEAD // 64), np.uint64), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for lo, hi in _pieces(offsets, LINES):
            own, k = self._placed(flat[offsets[lo] : offsets[hi]]), hi - lo
            owner = np.repeat(np.arange(k), np.diff(offsets[lo : hi + 1]))
            head, far = (own >= 0) & (own < HEAD), own >= HEAD
            one = np.zeros(k * HEAD, np.uint8)
            one[owner[head] * HEAD + own[head]] = 1
            bits[lo:hi] = np.packbits(one.reshape(k, HEAD), axis=1).view(np.uint64)
            tail.append(own[far] - HEAD)
            left.append(np.bincount(owner[far], minlength=k))
        return bits, np.concatenate(tail), np.cumsum(np.concatenate(left))

    def _placed(self, flat: np.ndarray) -> np.ndarray:
        if self.known is None:
            return self.place[np.minimum(flat, len(self.place) - 1)]
        at = np.searchsorted(self.known, flat)
        at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] != flat)] = len(self.known)
        return self.place[at]

    def meet(self, ids: np.ndarray, n: np.ndarray, flat: np.ndarray, offsets: np.ndarray, once: bool):
        """x, y (rows of the block and of the others, in ascending size) and Jaccard; once: a y that was met is not
        looked at again."""
        words = min(self.most, _words(int(n[-1])))
        if words not in self.signature:
            self.signature[words] = _folded(self.signature[self.most], words)
        mine, other = self.signature[words], _folded(signatures(flat, offsets, max(words, _words(int(n[-1])))), words)
        others = self._split(flat, offsets)
        t, far = self.threshold, (1 - self.threshold) / (1 + self.threshold) * (1 + 1e-6)  # more than single precision loses
        left = np.arange(len(n))
        lo = int(np.searchsorted(self.n, t * n[0] - EPS))
        hi = int(np.searchsorted(self.n, n[-1] if self.ordered else n[-1] / t + EPS, "right"))
        room_x = (self.n * far + 0.01).astype(np.float32)
        room_y = (n * far + 0.01).astype(np.float32)
        while lo < hi and len(left):
            top = min(hi, lo + max(1, CELLS // len(left)))
            apart, bit = np.zeros((len(left), top - lo), np.uint16), np.empty((len(left), top - lo), np.uint64)
            one = np.empty(bit.shape, np.uint8)
            for w in range(words):
                np.bitwise_xor(other[w][left][:, None], mine[w, lo:top][None, :], out=bit)
                apart += np.bitwise_count(bit, out=one)
            row, x = np.nonzero(apart <= room_y[left][:, None] + room_x[lo:top][None, :])
            x, y, lo = x + lo, left[row], top
            small, large = np.minimum(self.n[x], n[y]), np.maximum(self.n[x], n[y])
            good = (small >= t * large - EPS) & (self.ids[x] != ids[y])
            if self.ordered:
                good &= (self.n[x] < n[y]) | ((self.n[x] == n[y]) & (self.ids[x] < ids[y]))
            x, y = x[good], y[good]
            found = [self._shared(x[k : k + 16_384], y[k : k + 16_384], n, others) for k in range(0, len(x), 16_384)]
            if found:
                x, y, jaccard = (np.concatenate(z) for z in zip(*found, strict=True))
                if once:
                    left = np.setdiff1d(left, y)
                yield x, y, jaccard

    def _shared(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, others) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits, tail, ends = others
        total = self.n[x] + n[y]
        shared = np.bitwise_count(self.bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        most = shared + np.minimum(self.ends[x + 1] - self.ends[x], ends[y + 1] - ends[y])
        good = most >= self.threshold / (1 + self.threshold) * total - 0.01
        x, y, total, shared = x[good], y[good], total[good], shared[good]
        step = max(1, MARKS // self.listed)  # y is ascending
        first = int(y[0]) if len(y) else 0
        for lo in range(first, int(y[-1]) + 1 if len(y) else first, step):
            a, b = np.searchsorted(y, [lo, lo + step])
            if a == b:
                continue
            k = min(step, len(n) - lo)
            mark = np.zeros(k * self.listed, np.uint8)
            mark[np.repeat(np.arange(k), np.diff(ends[lo : lo + k + 1])) * self.listed + tail[ends[lo] : ends[lo + k]]] = 1
            code, size = _taken(self.tail, self.ends, x[a:b])
            sums = np.concatenate([[0], np.cumsum(mark[np.repeat((y[a:b] - lo) * self.listed, size) + code], dtype=np.int64)])
            at = np.concatenate([[0], np.cumsum(size)])
            shared[a:b] += sums[at[1:]] - sums[at[:-1]]
        jaccard = shared / (total - shared)
        good = jaccard >= self.threshold
        return x[good], y[good], jaccard[good]


def _joined(threshold: float, width: int, ordered: frozenset[int], pairs: bool):
    """Rows (task, kind, id, n, codes) sorted by task, kind and n: those of kind 0 are held, those of kind 1 meet them.
    ordered: tasks in which both kinds are the same block."""

    def block(held: list[pa.RecordBatch], task: int) -> _Block:
        ids, n = (np.concatenate([b.column(i).to_numpy() for b in held]).astype(np.int64) for i in (2, 3))
        parts = [_unpacked(b.column(4), width) for b in held]
        sizes = np.concatenate([np.diff(o) for _, o in parts])
        return _Block(ids, n, np.concatenate([f for f, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]), threshold, task in ordered)

    def run(batches):
        now, held, own = None, [], None
        for batch in batches:
            task, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.flatnonzero(np.diff(task) | np.diff(kind)) + 1 if len(task) else []
            for lo, hi in zip([0, *ends], [*ends, len(task)], strict=True):
                if lo == hi:
                    continue
                if task[lo] != now:
                    now, held, own = int(task[lo]), [], None
                piece = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append(piece)
                    continue
                if held:
                    own, held = block(held, now), []
                for k in range(0, piece.num_rows if own else 0, LINES):
                    rows = piece.slice(k, LINES)
                    ids, n = (rows.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                    met = []
                    for x, y, jaccard in own.meet(ids, n, *_unpacked(rows.column(4), width), not pairs):
                        if pairs and len(x):
                            a, b = own.ids[x], ids[y]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.round(jaccard, 6))], names=["a", "b", "jaccard"])
                        met.append(ids[y])
                    if not pairs and met and len(seen := np.unique(np.concatenate(met))):
                        yield pa.RecordBatch.from_arrays([pa.array(seen)], names=["id"])

    return run


def _sized(sets: DataFrame) -> tuple[list[tuple[int, int]], int, int]:
    """(size, count) ascending, least and greatest code."""
    rows = sets.groupBy(F.size("codes").alias("n")).agg(F.count("*").alias("c"), F.min(F.array_min("codes")).alias("least"), F.max(F.array_max("codes")).alias("most")).collect()
    rows = [r for r in rows if r["n"] > 0]
    return sorted((r["n"], r["c"]) for r in rows), min((r["least"] for r in rows), default=0), max((r["most"] for r in rows), default=0)


def _sent(place: dict[int, tuple[int, int]], tasks: dict[int, list[tuple[int, int]]], width: int):
    """Sets (id, codes) as rows of each of their block's (task, kind)."""

    def run(batches):
        for batch in batches:
            codes = batch.column(1)
            offsets, flat = codes.offsets.to_numpy().astype(np.int64), codes.values.to_numpy()
            flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
            n, ids = np.diff(offsets), batch.column(0).to_numpy()
            if width == 1 and len(flat):  # ascending within each set
                flat = flat[np.lexsort((flat, np.repeat(np.arange(len(n)), n)))]
            raw, at = _packed(flat, offsets, width)
            binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.tobytes())])
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            rows: dict[tuple[int, int], list[int]] = {}
            for i, (size, mix) in enumerate(zip(n.tolist(), mixed.tolist(), strict=True)):
                if size:
                    first, parts = place[size]
                    for at_task in tasks[first + mix % parts]:
                        rows.setdefault(at_task, []).append(i)
            own = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), binary], names=["id", "n", "codes"])
            for (task, kind), i in rows.items():
                some = own.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), task, np.int32)), pa.array(np.full(len(i), kind, np.int32)), *some.columns], names=["task", "kind", "id", "n", "codes"])

    return run


ROW = "task int, kind int, id long, n int, codes binary"


def _width(least: int, most: int) -> int:
    return 8 if least < 0 or most >= 1 << 31 else 4 if most >= COMPACT else 1


def _run(sent: DataFrame, n_tasks: int, threshold: float, width: int, ordered: frozenset[int], pairs: bool) -> DataFrame:
    dealt = sent.repartitionById(max(1, n_tasks), "task").sortWithinPartitions("task", "kind", "n")
    return dealt.mapInArrow(_joined(threshold, width, ordered, pairs), "a long, b long, jaccard double" if pairs else "id long")


def block_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of all pairs a < b of sets (id, codes: distinct) with Jaccard of at least threshold."""
    sizes, least, most = _sized(sets)
    bounds, place = _deal(sizes, BLOCKS, SETS)
    near = [(i, j) for i, x in enumerate(bounds) for j, y in enumerate(bounds) if i <= j and x[1] >= threshold * y[0] - EPS]
    tasks: dict[int, list[tuple[int, int]]] = {}
    for task, (i, j) in enumerate(near):
        tasks.setdefault(i, []).append((task, 0))
        tasks.setdefault(j, []).append((task, 1))
    width = _width(least, most)
    sent = sets.select("id", "codes").mapInArrow(_sent(place, tasks, width), ROW)
    return _run(sent, len(near), threshold, width, frozenset(k for k, (i, j) in enumerate(near) if i == j), True)


def block_met(held: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """id of the others (id, codes) that reach threshold with one of the held sets (id, codes) of another id."""
    (a, least_a, most_a), (b, least_b, most_b) = _sized(held), _sized(others)
    (bounds_a, place_a), (bounds_b, place_b) = _deal(a, max(2, BLOCKS // 4), SETS), _deal(b, BLOCKS, SETS)
    near = [(i, j) for i, x in enumerate(bounds_a) for j, y in enumerate(bounds_b) if x[1] >= threshold * y[0] - EPS and y[1] >= threshold * x[0] - EPS]
    tasks_a: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(bounds_a))}
    tasks_b: dict[int, list[tuple[int, int]]] = {j: [] for j in range(len(bounds_b))}
    for task, (i, j) in enumerate(near):
        tasks_a[i].append((task, 0))
        tasks_b[j].append((task, 1))
    width = _width(min(least_a, least_b), max(most_a, most_b))
    sent = held.select("id", "codes").mapInArrow(_sent(place_a, tasks_a, width), ROW).unionByName(others.select("id", "codes").mapInArrow(_sent(place_b, tasks_b, width), ROW))
    return _run(sent, len(near), threshold, width, frozenset(), False).distinct()
