"""Token links between two tokenizers, counted over the whole corpus in id-striped dense matrices.

Both tokenizers cut a text's bytes (behind one space) into tokens. Places where tokens of both sides end
cut them into groups; two tokens are linked where their byte ranges overlap. The number of an id pair is
how many documents hold it linked. Steps:

  link_blocks   a task takes some documents at once, finds their links from the byte offsets, sorts them by
                pair and writes one row for each band of A ids: pairs, documents of each pair, how often.
                A band is STRIPES / BANDS stripes; a stripe is the A ids with one rest modulo STRIPES, so
                frequent ids (small numbers in most vocabularies) are spread over all of them
  pair_counts   rows of a task are summed up before they travel; each stripe's pairs meet in one task, which
                adds them with np.add.at into a dense block (A ids of the stripe x B ids: a bound that no
                corpus moves), whose row maxima give the best B ids of each A id
  scored        links travel to the counts of their band. A band of many links is dealt over as many tasks
                as its links need, each with a copy of the band's counts; a task streams through its links

A document is judged on its row: repeated rows and rows without an id each count as a document of their own.
Null and empty texts, and texts that either tokenizer does not give back byte for byte (a normalising model
on runs of spaces), have no tokens: zeros and '' in every output. Extra columns, clashing names among them,
are ignored. An empty table gives no row. Of equal counts every pair is a best one.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, release, shuffle_partitions, stored, texts_of, tidy
from .tokens import ByteChunks, PieceChunks

STRIPES, BANDS = 256, 32
BLOCK_BYTES, BLOCK_DOCS = 1_000_000, 1 << 16
TABLE_CHUNKS = 400_000
HELD_PAIRS = 2_000_000  # pairs that a task holds before it passes its sums on
TASK_LINKS = 4_000_000
STATS = ("n_a", "n_b", "n_groups", "n_links")

BLOCKS = "block long, band int, links long, doc_ids array<long>, stats binary, digests binary, pairs binary, n_docs binary, docs binary, times binary"


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in the narrowest of four widths, told by the first byte."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


class _Side:
    """Token bytes of a vocabulary: lengths, all bytes side by side, decimal digits of the ids."""

    def __init__(self, names: list[bytes]):
        self.size = len(names)
        self.length = np.array([len(x) for x in names], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(names), np.uint8)
        wide = len(str(len(names)))
        self.digits = np.array([list(str(i).encode().ljust(wide, b"\0")) for i in range(len(names))], np.uint8)
        self.width = (self.digits > 0).sum(axis=1)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.begin[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _byte_names(path: str) -> list[bytes]:
    """Names of a byte-level vocabulary as bytes; every byte is shown by one character."""
    from tokenizers import Tokenizer

    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(shown))
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for name, i in vocab.items():
        out[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
    return out


def _piece_names(lib) -> list[bytes]:
    return [bytes([int(lib.id_to_piece(i)[3:-1], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace("▁", " ").encode() for i in range(lib.get_piece_size())]


class SpacedChunks(ByteChunks):
    """Texts behind one space that is no part of them: so every word has its leading space."""

    spaced = False

    def cut(self, texts):
        if not self.spaced:
            return super().cut(texts)
        kind = texts.type
        texts = pc.if_else(pc.match_substring(texts, "\0"), pa.scalar("\0\0", kind), pc.replace_substring(texts, " ", "\0 "))
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(" ", kind), texts, pa.scalar("", kind)), "\0")

    def _slow(self, text):
        return super()._slow(" " + text if self.spaced else text)

    def encode(self, texts):
        if self.spaced and self.whole:
            return [np.array(i, dtype="<u4").tobytes() if t else b"" for t, i in zip(texts, self.encode_all([" " + t for t in texts]), strict=True)]
        return super().encode(texts)


class _Pair:
    """Both tokenizers in one worker."""

    def __init__(self, a: str, b: str):
        self.table_a, self.table_b = SpacedChunks(a), PieceChunks(b)
        self.table_a.spaced = True
        self.table_a.most = self.table_b.most = TABLE_CHUNKS
        self.a, self.b = _Side(_byte_names(a)), _Side(_piece_names(self.table_b.lib))


def _pair(a: str, b: str) -> _Pair:
    key = ("alignment", a, b)
    release(key)
    if key not in KEPT:
        KEPT[key] = _Pair(a, b)
    return KEPT[key]


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of x over runs of n entries."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def aligned(pair: _Pair, texts: list[bytes], raw_a: list[bytes], raw_b: list[bytes]):
    """The numbers STATS of each document, its digest (b"" without tokens), and all links as (document, A id, B id).

    texts are the bytes behind one space, b"" where there are none; raw_a and raw_b ids as 32-bit numbers."""
    a, b = pair.a, pair.b
    size = np.array([len(t) for t in texts], np.int64)
    ids_a, ids_b = (np.frombuffer(b"".join(x), "<u4") for x in (raw_a, raw_b))
    n_a, n_b = (np.array([len(r) // 4 for r in x], np.int64) for x in (raw_a, raw_b))
    good = (size > 0) & (_sums(a.length[ids_a], n_a) == size) & (_sums(b.length[ids_b], n_b) == size)

    def narrowed():
        nonlocal ids_a, ids_b, n_a, n_b, size
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b, size = np.where(good, n_a, 0), np.where(good, n_b, 0), np.where(good, size, 0)

    narrowed()
    said = np.frombuffer(b"".join(t for t, g in zip(texts, good.tolist(), strict=True) if g), np.uint8)
    wrong = (a.bytes_of(ids_a) != said) | (b.bytes_of(ids_b) != said)
    if wrong.any():
        good &= _sums(wrong, size) == 0
        narrowed()

    end_a, end_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
    total = int(size.sum())
    flag_a, flag_b = np.zeros(total + 1, np.uint8), np.zeros(total + 1, np.uint8)
    flag_a[end_a] = 1
    flag_b[end_b] = 1
    both, cut = flag_a & flag_b, np.flatnonzero(flag_a | flag_b)
    before_a, before_b, groups = (np.cumsum(x, dtype=np.int64) for x in (flag_a, flag_b, both))
    # every stretch between two cuts belongs to one token of either side: one link
    link_a, link_b = ids_a[before_a[cut] - flag_a[cut]], ids_b[before_b[cut] - flag_b[cut]]
    ends = np.cumsum(size)
    n_links = np.diff(np.searchsorted(cut, ends, "right"), prepend=0)
    n_groups = np.diff(groups[ends], prepend=0) if len(ends) else np.zeros(0, np.int64)

    # decimal ids in the order of groups, side A first: each token's place among all of both sides
    close = np.flatnonzero(both)
    group_a, group_b = groups[end_a] - both[end_a], groups[end_b] - both[end_b]
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], before_b[close]])[group_a]
    place_b = np.arange(len(ids_b)) + before_a[close][group_b]
    wide = max(a.digits.shape[1], b.digits.shape[1])
    shown = np.zeros((len(ids_a) + len(ids_b), wide + 1), np.uint8)
    shown[place_a, : a.digits.shape[1]] = a.digits[ids_a]
    shown[place_b, : b.digits.shape[1]] = b.digits[ids_b]
    shown[place_a, wide] = np.where(both[end_a], ord("|"), ord(","))
    shown[place_b, wide] = np.where(both[end_b], ord(";"), ord(","))
    flat = shown.ravel()
    line = flat[flat > 0].tobytes()
    stop = np.cumsum(_sums(a.width[ids_a], n_a) + _sums(b.width[ids_b], n_b) + n_a + n_b)
    digests = [hashlib.sha256(line[x : y - 1]).digest() if y > x else b"" for x, y in zip([0, *stop.tolist()], stop.tolist(), strict=False)]
    return np.stack([n_a, n_b, n_groups, n_links]), digests, (np.repeat(np.arange(len(size)), n_links), link_a, link_b)


def _place(pair_a: int) -> int:
    """A ids of one stripe."""
    return -(-pair_a // STRIPES)


def _band_rows(block: int, size_a: int, size_b: int, doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """A block's links, sorted by stripe, pair and document, one row a band."""
    rows = _place(size_a)
    a = a.astype(np.int64)
    key = ((((a % STRIPES) * rows + a // STRIPES) * size_b + b) << 16) | doc
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times, key = np.diff(first, append=len(key)), key[first]
    pair = key >> 16
    start = np.flatnonzero(np.diff(pair, prepend=-1))
    n_docs, pair = np.diff(start, append=len(pair)), pair[start]
    one = STRIPES // BANDS * rows * size_b  # pairs of a band
    at = np.searchsorted(pair, np.arange(BANDS + 1) * one)
    stop = np.append(start, len(key))
    doc = key & 0xFFFF
    for band in range(BANDS):
        x, y = at[band], at[band + 1]
        if x < y:
            lo, hi = stop[x], stop[y]
            yield (block, band, int(hi - lo), None, None, None, packed(pair[x:y] - band * one), packed(n_docs[x:y]), packed(doc[lo:hi]), packed(times[lo:hi]))


def link_blocks(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of blocks (a written one): a row of band -1 with each document's numbers, then its bands."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6]
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches):
        pair = _pair(a, b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch)
            all_a = pair.table_a.encode(texts)
            all_b = pair.table_b.encode(texts)
            raw = [(" " + t).encode() if t else b"" for t in texts]
            at = 0
            while at < len(ids):
                start, size = at, 0
                while at < len(ids) and at - start < BLOCK_DOCS and (at == start or size + len(raw[at]) <= BLOCK_BYTES):
                    size += len(raw[at])
                    at += 1
                stats, digests, links = aligned(pair, raw[start:at], all_a[start:at], all_b[start:at])
                base = (block, -1, 0, ids[start:at], stats.astype("<i8").tobytes(), b"".join(d or bytes(32) for d in digests), None, None, None, None)
                rows = [base, *_band_rows(block, pair.a.size, pair.b.size, *links)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                block += 1

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, BLOCKS), "links")


def _summed(size_a: int, size_b: int, batches):
    """Pairs of a task's blocks with their numbers of documents, added up, one row a stripe."""
    one, rows = STRIPES // BANDS * _place(size_a) * size_b, _place(size_a) * size_b
    held, n = [], 0

    def squeezed():
        pair, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], count[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        return pair[first], np.add.reduceat(count, first)

    def out(pair, count):
        at = np.searchsorted(pair, np.arange(STRIPES + 1) * rows)
        full = [s for s in range(STRIPES) if at[s] < at[s + 1]]
        cols = [(s, packed(pair[at[s] : at[s + 1]] - s * rows), packed(count[at[s] : at[s + 1]])) for s in full]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cols, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["stripe", "pairs", "n_docs"])

    for batch in batches:
        for band, pairs, n_docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.append((unpacked(pairs).astype(np.int64) + band * one, unpacked(n_docs).astype(np.int64)))
            n += len(held[-1][0])
            if n > HELD_PAIRS:
                held = [squeezed()]
                n = len(held[0][0])
                if n > HELD_PAIRS // 2:
                    yield out(*held[0])
                    held, n = [], 0
    if n:
        yield out(*squeezed())


def _counted(size_a: int, size_b: int, batches):
    """A stripe's rows one after another: their pairs are added into a dense block, whose row maxima are best."""
    rows = _place(size_a)
    block = np.zeros(rows * size_b, np.int64)
    now = None

    def out():
        pair = np.flatnonzero(block)
        count = block[pair]
        best = count == block.reshape(rows, size_b).max(axis=1)[pair // size_b]
        block[pair] = 0
        cols = ([now // (STRIPES // BANDS)], [now], [packed(pair)], [packed(count)], [np.packbits(best).tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["band", "stripe", "pairs", "counts", "best"])

    for batch in batches:
        for stripe, pairs, n_docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if now is not None and stripe != now:
                yield out()
            now = stripe
            np.add.at(block, unpacked(pairs), unpacked(n_docs).astype(np.int64))
    if now is not None:
        yield out()


def sizes(a: str, b: str) -> tuple[int, int]:
    """The numbers of ids of both vocabularies."""
    import sentencepiece

    return len(_byte_names(a)), sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()


def pair_counts(blocks: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """One row a stripe (a written table): its pairs, how many documents hold each, and which are best."""
    pairs = blocks.filter("band >= 0").select("band", "pairs", "n_docs")
    sent = pairs.mapInArrow(tidy(partial(_summed, size_a, size_b)), "stripe int, pairs binary, n_docs binary")
    met = sent.repartition(min(STRIPES, shuffle_partitions(blocks.sparkSession)), "stripe").sortWithinPartitions("stripe")
    return stored(met.mapInArrow(tidy(partial(_counted, size_a, size_b)), "band int, stripe int, pairs binary, counts binary, best binary"), "counts")


def pair_table(counts: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """The counts as rows a, b, n_docs, best: which B ids stand for an A id."""

    def run(batches):
        for batch in batches:
            for stripe, pairs, count, best in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                pair, count = unpacked(pairs).astype(np.int64), unpacked(count).astype(np.int64)
                good = np.unpackbits(np.frombuffer(best, np.uint8), count=len(pair)).astype(bool)
                for lo in range(0, len(pair), 100_000):
                    p = pair[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p // size_b * STRIPES + stripe), pa.array(p % size_b), pa.array(count[lo : lo + 100_000]), pa.array(good[lo : lo + 100_000])], names=["a", "b", "n_docs", "best"]
                    )

    return counts.select("stripe", "pairs", "counts", "best").mapInArrow(tidy(run), "a long, b long, n_docs long, best boolean")


def _scored(size_a: int, size_b: int, batches):
    """Rows of a band and salt: its counts (stripes in order), then links; sums of each block's documents."""
    rows = _place(size_a) * size_b
    now, known, held = None, None, []

    def table():
        pair = np.concatenate([unpacked(p).astype(np.int64) + stripe % (STRIPES // BANDS) * rows for stripe, p, _, _ in held])
        count = np.concatenate([unpacked(c).astype(np.int64) for _, _, c, _ in held])
        best = np.concatenate([np.unpackbits(np.frombuffer(g, np.uint8), count=len(unpacked(p))) for _, p, _, g in held])
        return pair, count, best.astype(np.int64)

    for batch in batches:
        got = []
        for band, salt, block, stripe, pairs, x, y, z in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if (band, salt) != now:
                now, known, held = (band, salt), None, []
            if block is None:  # counts, best
                held.append((stripe, pairs, x, y))
                known = None
                continue
            if known is None:
                known = table()
            n_docs, doc, times = unpacked(x), unpacked(y), unpacked(z).astype(np.int64)
            at = np.repeat(np.searchsorted(known[0], unpacked(pairs).astype(np.int64)), n_docs)
            count, good = np.zeros((2, int(doc.max()) + 1), np.int64)
            np.add.at(count, doc, times * known[1][at])
            np.add.at(good, doc, times * known[2][at])
            some = np.flatnonzero(count)
            got.append((block, packed(some), packed(good[some]), packed(count[some])))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["block", "docs", "best", "counts"])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finished(batches):
    """A block's row of numbers, then its sums from every band: rows of documents."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    base = None

    def out():
        ids, stats, digests, best, count = base
        stats = np.frombuffer(stats, "<i8").reshape(len(STATS), -1)
        text = ["" if n == 0 else digests[32 * i : 32 * i + 32].hex() for i, n in enumerate(stats[0].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, stats), pa.array(best), pa.array(count), pa.array(text, pa.string())], names=names)

    for batch in batches:
        for ids, stats, digests, docs, best, count in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
            if docs is None:
                if base is not None:
                    yield out()
                base = (ids, stats, digests, *np.zeros((2, len(ids)), np.int64))
            else:
                at = unpacked(docs)
                base[3][at] += unpacked(best).astype(np.int64)
                base[4][at] += unpacked(count).astype(np.int64)
    if base is not None:
        yield out()


def scored(blocks: DataFrame, counts: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """One row per document of the blocks, with its links weighed by the counts."""
    links = blocks.filter("band >= 0")
    most = dict(links.groupBy("band").agg(F.sum("links")).collect())  # at most BANDS rows
    salts = F.array(*[F.lit(max(1, -(-most.get(band, 0) // TASK_LINKS))) for band in range(BANDS)])
    none = F.lit(None)
    own = counts.select(
        "band", F.explode(F.sequence(F.lit(0), F.get(salts, F.col("band")) - 1)).alias("salt"), none.cast("long").alias("block"), "stripe", "pairs", F.col("counts").alias("x"), F.col("best").alias("y"), none.cast("binary").alias("z")
    )
    dealt = F.pmod(F.xxhash64("block"), F.get(salts, F.col("band"))).cast("int").alias("salt")
    sent = own.unionByName(links.select("band", dealt, "block", F.lit(-1).alias("stripe"), "pairs", F.col("n_docs").alias("x"), F.col("docs").alias("y"), F.col("times").alias("z")))
    n = shuffle_partitions(blocks.sparkSession)
    met = sent.repartition(n, "band", "salt").sortWithinPartitions("band", "salt", F.col("block").asc_nulls_first(), "stripe")
    parts = met.mapInArrow(tidy(partial(_scored, size_a, size_b)), "block long, docs binary, best binary, counts binary")
    base = blocks.filter("band < 0").select("block", "doc_ids", "stats", "digests", none.cast("binary").alias("docs"), none.cast("binary").alias("best"), none.cast("binary").alias("counts"))
    parts = parts.select("block", none.cast("array<long>").alias("doc_ids"), none.cast("binary").alias("stats"), none.cast("binary").alias("digests"), "docs", "best", "counts")
    whole = base.unionByName(parts).repartition(n, "block").sortWithinPartitions("block", F.isnotnull("docs"))
    return whole.mapInArrow(tidy(_finished), RESULT)


def align(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups and weighed links of every text between a byte-level BPE (a) and a SentencePiece model (b)."""
    size_a, size_b = sizes(a, b)
    blocks = link_blocks(df, a, b, id_col, text_col)
    return scored(blocks, pair_counts(blocks, size_a, size_b), size_a, size_b)
