"""Exact substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Words are runs of bytes other than space and 0x09-0x0D. A window is removed if its words also start
earlier (smaller doc_id, or the same document further left); removed windows of a document merge into
maximal intervals of words. Windows are judged on the input alone.

The hashes only find candidates; a window is removed because its words are equal:

  1  every task hashes all windows of its texts, block by block. Within a block, windows of equal hash
     are compared word by word; later ones are settled, so one passage in a third of all rows costs each
     block one entry. The others go to buckets as 5 bytes of hash (the bucket is told from the rest)
     with their places, packed: one row per block and bucket.
  2  a bucket sends the places whose hash has come more than once back to their documents.
  3  documents answer with a 128-bit blake2b digest of the words of each such window. Of equal digests
     among the documents of one target again only the first goes on.
  4  buckets of digests find the first start of each; the others are removed from their documents.

Buckets and targets follow the bytes of the texts (BUCKET_BYTES each), so no task's load grows with the
table; beyond some TB a packed row holds few windows, at worst one. A text's numbers take 12 bytes a word.

Null and empty texts have no words and are kept as "". Documents shorter than a window stay whole.
Rows equal in id and text are one document; rows of one id with different texts are ordered by a hash
of the text; a null id comes before all others. Extra columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, shuffle_partitions, tidy
from .words import Words, mix, run_hashes, slices

NO_ID = -(1 << 63)
KEY_BYTES, DIGEST = 4, 16
BUCKET_BYTES = 8 << 20
MAX_WORDS = 300_000  # words a task keeps numbered between blocks


def text_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw)


def target_of(ids: np.ndarray, targets: int) -> np.ndarray:
    """The same place as Spark's crc32 of the id's decimal text gives."""
    return np.fromiter((zlib.crc32(b"%d" % i) % targets for i in ids.tolist()), np.int64, len(ids))


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal place side by side: the high bytes of small numbers compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8).reshape(k, -1).T.copy().view(dtype).ravel()


def _runs(doc: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Places in document order as runs: ids, text marks (a byte each, or 8), lengths, and positions."""
    if not len(doc):
        return b"", b"", b"", b""
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]))
    size = np.diff(np.append(cut, len(doc))).astype("<u4")
    return _planes(doc[cut].astype("<i8")), mark[cut].tobytes(), _planes(size), _planes(pos.astype("<u4"))


def _unrun(ids, marks, sizes, pos, kind):
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
    size = _unplanes(sizes, "<u4")
    return np.repeat(_unplanes(ids, "<i8"), size), np.repeat(np.frombuffer(marks, kind), size), _unplanes(pos, "<u4").astype(np.int64)


_PLACES = "ids binary, marks binary, sizes binary, pos binary"
_SENT = f"bucket int, keys binary, {_PLACES}"
_FOUND = f"target int, sure boolean, {_PLACES}"
_NAMES = ["ids", "marks", "sizes", "pos"]


def _table(rows: list[tuple], names: list[str], kinds: list) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]


def _dealt(order_by: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by part, in their own order within it, and where each part begins."""
    by = np.argsort(order_by, kind="stable")
    return by, np.searchsorted(order_by[by], np.arange(parts + 1))


def _later(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose key has come before (in the order of rows), and for each the first row of that key."""
    by = np.argsort(key)
    k = key[by]
    eq = k[1:] == k[:-1]
    many = by[np.concatenate([[False], eq]) | np.concatenate([eq, [False]])] if len(k) else by
    many = many[np.lexsort((many, key[many]))]
    again = np.concatenate([[False], key[many][1:] == key[many][:-1]]) if len(many) else np.zeros(0, bool)
    head = many[np.maximum.accumulate(np.where(again, 0, np.arange(len(many))))] if len(many) else many
    return many[again], head[again]


def _windows(width: int, buckets: int, block_windows: int):
    names, kinds = ["bucket", "keys", *_NAMES], [pa.int32(), *[pa.binary()] * 5]

    def flush(docs):
        """One block: of equal windows the first goes to its bucket, the others are settled."""
        docs.sort(key=lambda d: d[:2])
        size = np.array([len(d[2]) for d in docs])
        runs = size - width + 1
        ids, key = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
        doc, th = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.uint64)
        docs.clear()  # its arrays are joined now
        kind = np.int32 if len(ids) < 1 << 31 else np.int64
        owner = np.repeat(np.arange(len(doc), dtype=kind), runs)
        pos = np.arange(len(key), dtype=kind) - np.repeat((np.cumsum(runs) - runs).astype(kind), runs)
        at = pos + np.repeat((np.cumsum(size) - size).astype(kind), runs)
        late, head = _later(key)
        same = np.ones(len(late), bool)
        for k in range(width):  # the words themselves
            same &= ids[at[late] + k] == ids[at[head] + k]
        late, head = late[same], head[same]
        del ids, at, same
        go = np.ones(len(key), bool)
        go[late] = False
        # the same start again (rows equal in id and text) is not a later one
        a, b = owner[late], owner[head]
        gone = np.sort(late[(doc[a] != doc[b]) | (th[a] != th[b]) | (pos[late] != pos[head])])
        go = np.flatnonzero(go)
        mixed = mix(key[go])
        del key
        bucket = ((mixed >> np.uint64(8 * KEY_BYTES)) % np.uint64(buckets)).astype(np.int64)
        by, edges = _dealt(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, buckets)
        go, short = go[by], mixed[by].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        mark = th.astype(np.uint8)
        rows = []
        for x in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            e = go[edges[x] : edges[x + 1]]
            rows.append((x, short[edges[x] : edges[x + 1]].tobytes(), *_runs(doc[owner[e]], mark[owner[e]], pos[e])))
        if len(gone):
            rows.append((int(doc[0] % buckets), None, *_runs(doc[owner[gone]], th[owner[gone]], pos[gone])))
        return pa.RecordBatch.from_arrays(_table(rows, names, kinds), names=names)

    def run(batches):
        words, docs, held = Words(), [], 0
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                ids = words.numbers(raw)
                if len(ids) < width:
                    continue
                docs.append((d, text_hash(raw), ids, run_hashes(words.values(ids), width)))
                held += len(ids) - width + 1
                if held >= block_windows:
                    yield flush(docs)
                    held = 0
                    if len(words) > MAX_WORDS:
                        words.clear()
                    release()  # what a block took goes back before the next one grows
        if held:
            yield flush(docs)

    return run


def _columns(table: pa.Table, names: list[str]):
    return zip(*(table.column(c).to_pylist() for c in names), strict=True)


def _together(parts: list[tuple]) -> list[np.ndarray]:
    """Documents, marks and positions of all parts in order."""
    if not parts:
        return [np.zeros(0, np.int64)] * 3
    doc, mark, pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((pos, mark, doc))
    return [doc[order], mark[order], pos[order]]


def _by_target(parts: list[tuple], targets: int, sure: bool) -> list[tuple]:
    """Packed rows of places (document, mark, position) for each target."""
    doc, mark, pos = _together(parts)
    if not len(doc):
        return []
    own, inv = np.unique(doc, return_inverse=True)
    to = target_of(own, targets)[inv]
    by, _ = _dealt(to, 0)
    rows, cut = [], np.flatnonzero(np.concatenate([[True], to[by][1:] != to[by][:-1]]))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=True):
        e = by[a:b]
        rows.append((int(to[e[0]]), sure, *_runs(doc[e], mark[e], pos[e])))
    return rows


def _candidates(targets: int):
    """A bucket of hashes: the places whose hash has come more than once, and what blocks have settled."""

    def run(table: pa.Table) -> pa.Table:
        release(None)
        keys, found, settled = [], [], []
        for k, *packed in _columns(table, ["keys", *_NAMES]):
            if k is None:
                settled.append(_unrun(*packed, "<u8"))
            else:
                wide = np.zeros((len(k) // KEY_BYTES, 8), np.uint8)
                wide[:, :KEY_BYTES] = np.frombuffer(k, np.uint8).reshape(-1, KEY_BYTES)
                keys.append(wide.view("<u8").ravel())
                found.append(packed)
        rows = _by_target(settled, targets, True)
        if keys:
            key = np.concatenate(keys)
            by = np.argsort(key)
            eq = key[by][1:] == key[by][:-1]
            many = np.zeros(len(key), bool)
            many[by] = np.concatenate([[False], eq]) | np.concatenate([eq, [False]])
            parts, at = [], 0
            for packed in found:
                place = _unrun(*packed, "u1")
                own = many[at : at + len(place[0])]
                at += len(own)
                if own.any():
                    parts.append(tuple(p[own] for p in place))
            rows += _by_target(parts, targets, False)
        names, kinds = ["target", "sure", *_NAMES], [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
        return pa.table(_table(rows, names, kinds), names=names)

    return run


def _places(rows: pa.Table, sure: bool) -> dict:
    """Positions by (document, mark), of one kind."""
    doc, mark, pos = _together([_unrun(*packed, "<u8" if sure else "u1") for s, *packed in _columns(rows, ["sure", *_NAMES]) if s is sure])
    if not len(doc):
        return {}
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]))
    return {(int(doc[a]), int(mark[a])): pos[a:b] for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True)}


def _digests(width: int, buckets: int):
    """A target: digests of its documents' candidate windows, to buckets; settled places go along."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        release(None)
        rows = [(0, None, *packed) for s, *packed in _columns(found, ["sure", *_NAMES]) if s]
        asked = _places(found, False) if found.num_rows else {}
        ids = docs.column("id").to_pylist()
        wanted, doc, th, pos, digest = {d for d, _ in asked}, [], [], [], []
        texts = docs.column("text")
        starts = []
        for row, d in enumerate(ids):
            if d in wanted:
                raw = texts[row].as_py().encode()
                h = text_hash(raw)
                at = asked.get((d, h & 255))
                if at is not None:
                    starts.append((d, h, raw, at))
        starts.sort(key=lambda s: s[:2])
        for d, h, raw, at in starts:
            words = [w for part in slices(raw) for w in part]
            for p in at.tolist():
                if p + width <= len(words):
                    digest.append(hashlib.blake2b(b" ".join(words[p : p + width]), digest_size=DIGEST).digest())
                    doc.append(d), th.append(h), pos.append(p)
        if digest:
            doc, th, pos = np.array(doc, np.int64), np.array(th, np.uint64), np.array(pos, np.int64)
            first: dict[bytes, int] = {}
            head = np.fromiter((first.setdefault(g, i) for i, g in enumerate(digest)), np.int64, len(digest))
            late = np.flatnonzero((head < np.arange(len(head))) & ((doc[head] != doc) | (th[head] != th) | (pos[head] != pos)))
            if len(late):
                rows.append((0, None, *_runs(doc[late], th[late], pos[late])))
            go = np.array(list(first.values()))
            own = np.frombuffer(b"".join(first), np.uint8).reshape(-1, DIGEST)
            by, edges = _dealt((own[:, :8].copy().view("<u8").ravel() % np.uint64(buckets)).astype(np.int64), buckets)
            for x in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                e = np.sort(by[edges[x] : edges[x + 1]])
                rows.append((x, own[e].tobytes(), *_runs(doc[go[e]], th[go[e]], pos[go[e]])))
        spread = target_of(np.array([ids[0] if ids else 0]), buckets)[0]
        rows = [(int(spread) if keys is None else x, keys, *packed) for x, keys, *packed in rows]
        names, kinds = ["bucket", "keys", *_NAMES], [pa.int32(), *[pa.binary()] * 5]
        return pa.table(_table(rows, names, kinds), names=names)

    return run


def _firsts(targets: int):
    """A bucket of digests: all places of a digest but the first, and what has been settled before."""

    def run(table: pa.Table) -> pa.Table:
        release(None)
        keys, found, out = [], [], []
        for k, *packed in _columns(table, ["keys", *_NAMES]):
            if k is not None:
                keys.append(np.frombuffer(k, "<u8").reshape(-1, 2))
            (out if k is None else found).append(_unrun(*packed, "<u8"))
        if keys:
            doc, th, pos = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((pos, th, doc))
            doc, th, pos, key = doc[order], th[order], pos[order], np.concatenate(keys)[order]
            _, key = np.unique(key, axis=0, return_inverse=True)
            late, head = _later(key.ravel())
            own = (doc[head] == doc[late]) & (th[head] == th[late]) & (pos[head] == pos[late])
            out.append(tuple(x[late[~own]] for x in (doc, th, pos)))
        names, kinds = ["target", "sure", *_NAMES], [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
        return pa.table(_table(_by_target(out, targets, True), names, kinds), names=names)

    return run


def _cut(width: int, outputs: tuple[str, ...], id_col: str, text_col: str = "text", carry: tuple[str, ...] = ()):
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "kept_sha256": pa.string(), "intervals": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))}

    def run(docs: pa.Table, removed: pa.Table) -> pa.Table:
        release(None)
        gone = _places(removed, True) if removed.num_rows else {}
        touched = {d for d, _ in gone}
        ids, cols = docs.column("id").to_pylist(), {o: [] for o in outputs}
        for d, text in zip(ids, docs.column("text").to_pylist(), strict=True):
            raw = text.encode()
            pos = gone.get((d, text_hash(raw))) if d in touched else None
            n, parts, spans, removed_words = 0, [], [], 0
            if pos is None:
                for words in slices(raw):
                    n += len(words)
                    if words:
                        parts.append(b" ".join(words))
            else:
                step = np.zeros(int(pos[-1]) + width + 1, np.int64)
                np.add.at(step, pos, 1)
                np.subtract.at(step, pos + width, 1)
                over = np.cumsum(step)[:-1] > 0  # words behind it stay
                removed_words = int(over.sum())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], over.astype(np.int8), [0]]))).tolist()
                spans = [{"first": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                for words in slices(raw):
                    own = over[n : n + len(words)].tolist()
                    n += len(words)
                    left = [w for w, x in zip(words, own, strict=False) if not x] + words[len(own) :]
                    if left:
                        parts.append(b" ".join(left))
            joined = b" ".join(parts)
            made = {"n_words": n, "n_removed": removed_words, "intervals": spans}
            for o, c in cols.items():
                c.append(made[o] if o in made else joined.decode() if o == "kept" else hashlib.sha256(joined).hexdigest())
        out_ids = pa.array([None if d == NO_ID else d for d in ids], pa.int64())
        passed = []
        for c in carry:
            if c == text_col:
                void = docs.column("void").to_pylist()
                passed.append(pa.array([None if v else x for x, v in zip(docs.column("text").to_pylist(), void, strict=True)], pa.string()))
            else:
                passed.append(docs.column(f"carry_{c}"))
        return pa.table([out_ids, *(pa.array(cols[o], kinds[o]) for o in outputs), *passed], names=[id_col, *outputs, *carry])

    return run


def remove_repeats(df: DataFrame, width: int = 20, outputs=("n_words", "n_removed", "kept", "intervals"), id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, block_windows: int = 1_000_000, carry=()) -> DataFrame:
    """Per row of df: its id and of n_words, n_removed, kept (words left, joined by one space),
    kept_sha256 and intervals (maximal removed runs of words, end exclusive) those in outputs; carry
    names columns of df to pass on. bucket_bytes and block_windows bound what a task holds at once."""
    outputs, carry = tuple(outputs), tuple(carry)
    size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n = m = max(shuffle_partitions(df.sparkSession), -(-size // bucket_bytes))  # buckets and targets
    kinds = {"n_words": "long", "n_removed": "long", "kept": "string", "kept_sha256": "string", "intervals": "array<struct<first:bigint,end:bigint>>"}
    given = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    wide = df.select(ident, text, F.col(text_col).isNull().alias("void"), *[F.col(c).alias(f"carry_{c}") for c in carry if c != text_col])
    dealt = wide.withColumn("target", (F.crc32(F.col("id").cast("string")) % m).cast("int")).groupBy("target")
    sent = df.select(ident, text).mapInArrow(tidy(_windows(width, n, block_windows)), _SENT)
    asked = sent.groupBy("bucket").applyInArrow(_candidates(m), _FOUND)
    answers = dealt.cogroup(asked.groupBy("target")).applyInArrow(_digests(width, n), _SENT)
    gone = answers.groupBy("bucket").applyInArrow(_firsts(m), _FOUND)
    schema = ", ".join([f"{id_col} long", *(f"{o} {kinds[o]}" for o in outputs), *(f"`{c}` {given[c]}" for c in carry)])
    return dealt.cogroup(gone.groupBy("target")).applyInArrow(_cut(width, outputs, id_col, text_col, carry), schema)
