"""Search indexes stored as tables: postings with block bounds (sparse) and layered neighbour graphs (dense).

Both are dealt into shards of bounded size by a hash of the row id; the number of shards grows with the rows.
A search sends the query set, in packs of bounded size, to every shard: a task loads the parts of one shard
that its queries need, then streams the packs past it and passes k hits a query on. Nothing is collected to
the driver and no side grows with the data in a broadcast.

  postings   one row for each token of a shard: its local rows, their weights, and for each run of RANGE rows
             the largest weight. A query adds these bounds up, reads ranges from the largest bound downwards
             and stops where no range left can reach its k-th hit: exact top-k
  graph      one row a vector: its links on each layer (levels by a hash of the id). Links are the nearest
             neighbours in the space in which the inner product orders as the distance does, thinned so that no
             kept neighbour is nearer to another kept one, and some rows of the largest inner products. The
             lowest layer of few rows is scored whole; from its best rows a beam goes down layer by layer

Facets: an index row may carry a small number (a class of audience and validity, say), a query the numbers it
may see. Rows of other facets are no hits; they neither take a place among the k nor narrow the beam.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import scratch
from .vector import top_k

SHARD_POSTINGS, SHARD_CHARS, RANGE = 1_000_000, 6_000_000, 16
SHARD_VECTORS, LINKS, CANDIDATES, SLACK = 20_000, 16, 64, 1.4
START = 2000  # rows of the layer that is scored whole
PACK = 256  # queries that pass a shard together
MOST_TOKENS = 500_000  # of a query set whose tokens are broadcast

POSTINGS = "shard int, token string, local binary, weights binary, ranges binary, starts binary, bounds binary"
NODES = "shard int, id long, facet int, level int, vec array<double>, links array<array<int>>"
HITS = "query_id long, id long, score double, n_read long, n_stored long"


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _of(col: str, n: int):
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def _grouped(batches, key: int = 0):
    """Runs of rows with one value of a column, as tables (a shard is of bounded size)."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and x[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = x[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _emit(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ", 1) for x in schema.split(", ")), strict=True)
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


# ------------------------------------------------------------------ postings
def _shard_rows(shard: int, ids: np.ndarray, facet: np.ndarray, names: list[str], code: np.ndarray, local: np.ndarray, weight: np.ndarray):
    """The row of ids of one shard, then a row for each token; (code, local) once, in any order.

    Rows of large weights come first, so that ranges differ in what they can reach."""
    best_first = np.argsort(-np.bincount(local, np.abs(weight), len(ids)), kind="stable")
    place = np.empty(len(ids), np.int64)
    place[best_first] = np.arange(len(ids))
    ids, facet, local = ids[best_first], facet[best_first], place[local]
    order = np.argsort((code.astype(np.int64) << 32) | local)
    code, local, weight = code[order], local[order].astype("<u4"), weight[order].astype("<f8")
    block = (local // RANGE).astype("<u4")
    cut = np.flatnonzero(np.diff(code, prepend=-1))
    new = np.flatnonzero((np.diff(block.astype(np.int64), prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    bound = np.maximum.reduceat(np.abs(weight), new) if len(new) else np.zeros(0)
    stop = np.append(cut[1:], len(code))
    starts = (new - np.repeat(cut, np.diff(np.append(np.searchsorted(new, cut), len(new))))).astype("<u4")
    raw = [x.tobytes() for x in (local, weight, block[new], starts, bound)]
    rows = [(shard, None, ids.astype("<i8").tobytes(), facet.astype("<i4").tobytes(), None, None, None)]
    for c, x, y, p, q in zip(code[cut].tolist(), cut.tolist(), stop.tolist(), np.searchsorted(new, cut).tolist(), np.searchsorted(new, stop).tolist(), strict=True):
        rows.append((shard, names[c], raw[0][4 * x : 4 * y], raw[1][8 * x : 8 * y], raw[2][4 * p : 4 * q], raw[3][4 * p : 4 * q], raw[4][8 * p : 8 * q]))
        if len(rows) >= 20_000:
            yield _emit(rows, POSTINGS)
            rows = []
    if rows:
        yield _emit(rows, POSTINGS)


def _post(batches):
    """Shards of (shard, id, facet, token, weight)."""
    for part in _grouped(batches):
        ids, first, local = np.unique(part.column("id").to_numpy(), return_index=True, return_inverse=True)
        coded = part.column("token").combine_chunks().dictionary_encode()
        yield from _shard_rows(int(part.column("shard")[0].as_py()), ids, part.column("facet").to_numpy()[first], coded.dictionary.to_pylist(), coded.indices.to_numpy(), local, part.column("weight").to_numpy())


def _post_words(batches):
    """Shards of (shard, id, facet, words): the weight of a word is 1 + ln of its count."""
    for part in _grouped(batches):
        words = part.column("words").combine_chunks()
        coded = words.flatten().dictionary_encode()
        owner = np.repeat(np.arange(part.num_rows), np.diff(words.offsets.to_numpy()))
        key, n = np.unique((coded.indices.to_numpy().astype(np.int64) << 32) | owner, return_counts=True)
        yield from _shard_rows(int(part.column("shard")[0].as_py()), part.column("id").to_numpy(), part.column("facet").to_numpy(), coded.dictionary.to_pylist(), key >> 32, key & 0xFFFFFFFF, 1 + np.log(n))


def _facet(rows: DataFrame):
    return (F.coalesce(F.col("facet").cast("int"), F.lit(0)) if "facet" in rows.columns else F.lit(0)).alias("facet")


def sparse_index(rows: DataFrame, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The written table of postings of (id, token, weight[, facet]); (id, token) once. Rows without an id or token go."""
    own = scratch(rows.select(F.col("id").cast("long").alias("id"), _facet(rows), "token", F.col("weight").cast("double").alias("weight")).filter("id is not null and token is not null"))
    shards = max(1, -(-own.count() // shard_postings))
    dealt = own.select(_of("id", shards).alias("shard"), "*").repartition(min(shards, _parts(rows)), "shard").sortWithinPartitions("shard")
    return scratch(dealt.mapInArrow(_post, POSTINGS))


def text_index(rows: DataFrame, words: Column, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The same of texts (id, text[, facet]) by the given array of words; ids are distinct. Words of one text stay
    together, so nothing is exploded and the texts' words travel once. Rows without an id or text go."""
    own = rows.select(F.col("id").cast("long").alias("id"), _facet(rows), "text").filter("id is not null and text is not null")
    shards = max(1, -(-(own.agg(F.sum(F.length("text"))).first()[0] or 0) // shard_chars))
    dealt = own.select(_of("id", shards).alias("shard"), "id", "facet", words.alias("words")).repartition(min(shards, _parts(rows)), "shard").sortWithinPartitions("shard")
    return scratch(dealt.mapInArrow(_post_words, POSTINGS))


class _Shard:
    """The postings of one shard that a query set needs."""

    def __init__(self, ids: bytes, facets: bytes):
        self.ids, self.facets = np.frombuffer(ids, "<i8"), np.frombuffer(facets, "<i4")
        self.ranges = -(-len(self.ids) // RANGE)
        self.tokens: dict[str, tuple] = {}
        self.n_read = self.n_stored = 0

    def add(self, token, local, weights, ranges, starts, bounds):
        local, starts = np.frombuffer(local, "<u4"), np.frombuffer(starts, "<u4").astype(np.int64)
        self.tokens[token] = (local, np.frombuffer(weights, "<f8"), np.frombuffer(ranges, "<u4"), starts, np.append(starts[1:], len(local)), np.frombuffer(bounds, "<f8"))

    def search(self, words: list[tuple[str, float]], k: int, facets: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (rounded to 6) of the k best by score, then id."""
        own = [(w, *self.tokens[t]) for t, w in words if t in self.tokens]
        self.n_stored += sum(len(x[1]) for x in own)
        if not own:
            return self.ids[:0], np.zeros(0)
        bound = np.zeros(self.ranges)
        for w, _, _, ranges, _, _, tops in own:
            bound[ranges] += abs(w) * tops
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score, open_to = np.zeros(len(self.ids)), np.ones(len(self.ids), bool) if facets is None else np.isin(self.facets, facets)
        ids, best, at, step = self.ids[:0], np.zeros(0), 0, max(4, -(-2 * k // RANGE))
        while at < len(order) and not (len(best) == k and bound[order[at]] + 1e-6 < best[-1]):
            chosen = np.zeros(self.ranges, bool)
            chosen[order[at : at + step]] = True
            for w, local, weights, ranges, starts, stops, _ in own:
                hit = chosen[ranges]
                if not hit.any():
                    continue
                n = stops[hit] - starts[hit]
                ends = np.cumsum(n)
                place = np.repeat(starts[hit] - ends + n, n) + np.arange(ends[-1])
                score[local[place]] += w * weights[place]
                self.n_read += len(place)
            rows = (order[at : at + step, None] * RANGE + np.arange(RANGE)).ravel()
            rows = rows[rows < len(self.ids)]
            value = np.round(score[rows], 6)
            good = (value > 0) & open_to[rows]
            ids, best = np.concatenate([ids, self.ids[rows[good]]]), np.concatenate([best, value[good]])
            top = np.lexsort((ids, -best))[:k]
            ids, best = ids[top], best[top]
            at, step = at + step, step * 2
        return ids, best


def _packs(queries: DataFrame, fields: list[str], shards: DataFrame) -> tuple[DataFrame, int]:
    """Query rows in packs of about PACK queries, a copy of each for every shard; in how many groups the packs pass
    a shard: one where there are as many shards as tasks, more where few shards meet many packs."""
    n = max(1, -(-queries.select("query_id").distinct().count() // PACK))
    groups = max(1, min(n, -(-_parts(shards) // max(1, shards.count()))))
    pack = queries.groupBy(_of("query_id", n).alias("pack")).agg(F.collect_list(F.struct("query_id", *fields)).alias("asked"))  # PACK queries on average
    return pack.withColumn("team", F.col("pack") % groups).crossJoin(F.broadcast(shards)), groups  # a row for each pack and shard: the work itself


def _teams(groups: int):
    return F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("team")


def _facets(queries: DataFrame):
    return F.col("facets").cast("array<int>") if "facets" in queries.columns else F.lit(None).cast("array<int>")


def _search_postings(k: int, batches):
    shard, at = None, None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(10)]
        for number, team, kind, token, local, weights, ranges, starts, bounds, asked in zip(*cols, strict=True):
            if (number, team) != at:
                shard, at = None, (number, team)
            if kind == 0:
                shard = _Shard(local, weights)
            elif kind == 1:
                shard.add(token, local, weights, ranges, starts, bounds)
            elif shard is not None:
                words: dict[int, tuple[list, list | None]] = {}
                for q in asked:
                    words.setdefault(q["query_id"], ([], q["facets"]))[0].append((q["token"], q["weight"]))
                shard.n_read = shard.n_stored = 0
                found = [(q, *shard.search(own, k, facets)) for q, (own, facets) in words.items()]
                rows = [(q, i, s, None, None) for q, ids, best in found for i, s in zip(ids.tolist(), best.tolist(), strict=True)]
                yield _emit([*rows, (None, None, None, shard.n_read, shard.n_stored)], HITS)


def _asked_postings(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = index.sparkSession
    queries = queries.select("query_id", "token", F.col("weight").cast("double").alias("weight"), _facets(queries).alias("facets"))
    words = queries.select("token").distinct()
    few = words.count() <= MOST_TOKENS
    need = index.join(F.broadcast(words) if few else words, "token", "left_semi").withColumn("kind", F.lit(1))
    heads = index.filter("token is null").withColumn("kind", F.lit(0))  # one row a shard
    none = F.lit(None)
    parts = ["kind", "token", "local", "weights", "ranges", "starts", "bounds"]
    packs, groups = _packs(queries, ["token", "weight", "facets"], heads.select("shard"))
    packs = packs.select("shard", "team", F.lit(2).alias("kind"), none.cast("string").alias("token"), *[none.cast("binary").alias(c) for c in parts[2:]], "asked")
    kind = packs.schema["asked"].dataType
    rows = need.unionByName(heads).select("shard", _teams(groups), *parts, none.cast(kind).alias("asked")).unionByName(packs)
    met = rows.repartition(_parts(index), "shard", "team").sortWithinPartitions("shard", "team", "kind")
    return met.mapInArrow(partial(_search_postings, k), HITS)


def sparse_index_search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: exactly the hits of vector.sparse_search; queries (query_id, token, weight[, facets])."""
    return top_k(_asked_postings(index, queries, k).filter("query_id is not null").select("query_id", "id", "score"), "query_id", "score", k, ["id"])


def postings_read(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: how many postings of their tokens the searches read, and how many are stored."""
    return _asked_postings(index, queries, k).filter("query_id is null").agg(F.sum("n_read").alias("n_read"), F.sum("n_stored").alias("n_stored"))


# ------------------------------------------------------------------ graphs
def _augmented(vec: np.ndarray) -> np.ndarray:
    """Vectors of one length whose distances order as the inner products with any query do."""
    norm = (vec * vec).sum(axis=1)
    return np.concatenate([vec, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1) if len(vec) else vec


def _neighbours(vec: np.ndarray, x: np.ndarray, most: int, candidates: int) -> np.ndarray:
    """Links of every row, -1 where there are fewer: its thinned nearest neighbours in x, the nearest links
    back, then the rows of the largest inner products."""
    n = len(x)
    c = min(candidates, n - 1)
    if c <= 0:
        return np.full((n, 1), -1, np.int32)
    own = (x * x).sum(axis=1)
    kept_from, kept_to, kept_far = [], [], []
    out = np.full((n, 2 * most + most // 2), -1, np.int32)
    best = min(most // 2, n - 1)
    for lo in range(0, n, 512):
        part = x[lo : lo + 512]
        product = vec[lo : lo + 512] @ vec.T
        product[np.arange(len(part)), np.arange(lo, lo + len(part))] = -np.inf
        out[lo : lo + 512, 2 * most : 2 * most + best] = np.argpartition(-product, best - 1, axis=1)[:, :best]
        far = own[lo : lo + 512, None] + own[None] - 2 * part @ x.T
        far[np.arange(len(part)), np.arange(lo, lo + len(part))] = np.inf
        near = np.argpartition(far, c - 1, axis=1)[:, :c] if c < n else np.argsort(far, axis=1)[:, :c]
        d = np.take_along_axis(far, near, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
        y = x[near]
        pair = own[near][:, :, None] + own[near][:, None] - 2 * np.einsum("bcd,bed->bce", y, y, optimize=True)
        keep = np.zeros(d.shape, bool)
        for j in range(c):
            # nearer to the row than, with some slack, to every one kept so far
            keep[:, j] = (np.where(keep, pair[:, j], np.inf).min(axis=1) * SLACK > d[:, j]) & (keep.sum(axis=1) < most)
        keep |= ~keep & (np.cumsum(~keep, axis=1) <= (most - keep.sum(axis=1))[:, None])  # free places go to the nearest others
        row, col = np.nonzero(keep)
        kept_from.append(row + lo)
        kept_to.append(near[row, col])
        kept_far.append(d[row, col])
    a, b, d = (np.concatenate(z) for z in (kept_from, kept_to, kept_far))
    back = np.repeat([False, True], len(a))  # links back take the places that are left, so no thinned link goes
    a, b, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    key, first = np.unique(a * n + b, return_index=True)
    a, b, d, back = key // n, key % n, d[first], back[first]
    order = np.lexsort((b, d, back, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    good = rank < 2 * most
    out[a[good], rank[good]] = b[good]
    return out


def _levels(ids: np.ndarray, links: int) -> np.ndarray:
    """Level of each row by a hash of its id: a share of 1 / links goes one up."""
    x = ids.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum(-np.log(np.maximum(u, 1e-12)) / np.log(links), 8).astype(np.int64)


def _link(links: int, candidates: int, batches):
    for part in _grouped(batches):
        shard, ids, facet = int(part.column("shard")[0].as_py()), part.column("id").to_numpy(), part.column("facet").to_numpy()
        vec = np.array(part.column("vec").to_pylist(), np.float64)
        x, level = _augmented(vec), _levels(ids, links)
        own: list[list] = [[] for _ in ids]
        for at in range(int(level.max()) + 1):
            member = np.flatnonzero(level >= at)
            near = _neighbours(vec[member], x[member], 2 * links, candidates)
            for i, row in zip(member.tolist(), near, strict=True):
                own[i].append(member[list(dict.fromkeys(row[row >= 0].tolist()))].tolist())
        for lo in range(0, len(ids), 2000):
            hi = min(lo + 2000, len(ids))
            yield _emit([(shard, int(ids[i]), int(facet[i]), int(level[i]), vec[i].tolist(), own[i]) for i in range(lo, hi)], NODES)


def graph_index(rows: DataFrame, links: int = LINKS, candidates: int = CANDIDATES, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """The written table of nodes of (id, vec[, facet]); rows without an id or a vector have none. Every other row is in it."""
    own = scratch(rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), _facet(rows)).filter("id is not null and vec is not null"))
    shards = max(1, -(-own.count() // shard_vectors))
    dealt = own.withColumn("shard", _of("id", shards)).repartition(min(shards, _parts(rows)), "shard").sortWithinPartitions("shard", "id")
    return scratch(dealt.select("shard", "id", "vec", "facet").mapInArrow(partial(_link, links, candidates), NODES))


class _Graph:
    """One shard's nodes, links as rows of equal width."""

    def __init__(self, part: pa.Table):
        self.ids, self.level, self.facets = (part.column(c).to_numpy() for c in ("id", "level", "facet"))
        vec = part.column("vec").combine_chunks()
        self.vec = vec.flatten().to_numpy().reshape(len(self.ids), -1)
        links = part.column("links").to_pylist()
        # the lowest layer of few rows starts every search; what is below it has its links as a table
        self.start = next(at for at in range(int(self.level.max()) + 2) if (self.level >= at).sum() <= START or at == self.level.max() + 1)
        self.first = np.flatnonzero(self.level >= min(self.start, self.level.max()))
        self.layers = [self._table([own[at] if len(own) > at else [] for own in links]) for at in range(1, self.start)]
        # on the lowest layer the links of all layers are open: the higher ones lead out of a cluster
        self.all = self._table([list(dict.fromkeys(x for layer in own for x in layer)) for own in links])

    @staticmethod
    def _table(lists: list[list[int]]) -> np.ndarray:
        wide = max(1, max(map(len, lists)))
        return np.array([own + [-1] * (wide - len(own)) for own in lists], np.int32)

    def search(self, q: np.ndarray, k: int, beam: int, facets: list[list[int] | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and inner products (rounded to 6) of about the k best rows, for all queries of a pack at once."""
        n, m = len(self.ids), len(q)
        open_to = np.stack([np.ones(n, bool) if f is None else np.isin(self.facets, f) for f in facets])
        out: list = [None] * m
        thin = np.flatnonzero(open_to.sum(axis=1) <= max(4 * beam, n // 10))  # few rows are open: all of them are scored
        for i in thin.tolist():
            rows = np.flatnonzero(open_to[i])
            out[i] = self._best(rows, self.vec[rows] @ q[i], k)
        wide = np.setdiff1d(np.arange(m), thin)
        if len(wide):
            for i, got in zip(wide.tolist(), self._walk(q[wide], k, beam, open_to[wide]), strict=True):
                out[i] = got
        return out

    def _best(self, rows: np.ndarray, score: np.ndarray, k: int):
        ids, score = self.ids[rows], np.round(score, 6)
        top = np.lexsort((ids, -score))[:k]
        return ids[top], score[top]

    def _walk(self, q: np.ndarray, k: int, beam: int, open_to: np.ndarray):
        n, m = len(self.ids), len(q)
        score = q @ self.vec[self.first].T
        width = min(beam // 2 + 1, len(self.first))
        pick = np.argpartition(-score, width - 1, axis=1)[:, :width]
        ids, value = self.first[pick], np.take_along_axis(score, pick, axis=1)
        for layer in reversed(self.layers):
            ids, value, _ = self._beam(q, layer, ids, value, beam)
        hits = [np.repeat(np.arange(m), len(self.first)), np.tile(self.first, m), score.ravel()]
        _, _, more = self._beam(q, self.all, ids, value, beam)
        row, node, got = (np.concatenate([a, b]) for a, b in zip(hits, more, strict=True))
        good = open_to[row, node]
        key, first = np.unique(row[good] * n + node[good], return_index=True)
        row, node, got = key // n, key % n, got[good][first]
        cut = np.searchsorted(row, np.arange(m + 1))
        return [self._best(node[x:y], got[x:y], k) for x, y in zip(cut, cut[1:], strict=False)]

    def _beam(self, q: np.ndarray, links: np.ndarray, ids: np.ndarray, value: np.ndarray, beam: int):
        """The best rows that links lead to from ids, for all queries at once; and every row that was scored."""
        n, m, line = len(self.ids), len(q), np.arange(len(q))[:, None]
        room = max(0, beam - ids.shape[1])
        ids, value = np.pad(ids, ((0, 0), (0, room)), constant_values=-1), np.pad(value, ((0, 0), (0, room)), constant_values=-np.inf)
        spread = ids < 0
        seen = np.zeros((m, n), bool)
        row, col = np.nonzero(~spread)
        seen[row, ids[row, col]] = True
        told = [(row, ids[row, col], value[row, col])]
        while not spread.all():
            pick = np.argsort(np.where(spread, np.inf, -value), axis=1)[:, :4]
            live = ~spread[line, pick]
            spread[line, pick] = True
            near = np.where(live[:, :, None], links[np.where(live, ids[line, pick], 0)], -1).reshape(m, -1)
            row, col = np.nonzero(near >= 0)
            key = np.unique(row * n + near[row, col])
            row, node = key // n, key % n
            new = ~seen[row, node]
            row, node = row[new], node[new]
            if not len(row):
                continue
            seen[row, node] = True
            got = np.einsum("rd,rd->r", q[row], self.vec[node])
            told.append((row, node, got))
            count = np.bincount(row, minlength=m)
            place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            new_ids, new_value = np.full((m, count.max()), -1), np.full((m, count.max()), -np.inf)
            new_ids[row, place], new_value[row, place] = node, got
            all_ids, all_value, all_spread = (np.concatenate(p, axis=1) for p in ((ids, new_ids), (value, new_value), (spread, new_ids < 0)))
            keep = np.argpartition(-all_value, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids, value, spread = all_ids[line, keep], all_value[line, keep], all_spread[line, keep]
        return ids, value, [np.concatenate(x) for x in zip(*told, strict=True)]


def _search_graph(k: int, beam: int, batches):
    for part in _grouped(batches):
        kinds = part.column("kind").to_numpy()
        graph = _Graph(part.filter(pa.array(kinds == 0)))
        for asked in part.filter(pa.array(kinds == 1)).column("asked").to_pylist():
            got = graph.search(np.array([q["vec"] for q in asked]), k, beam, [q["facets"] for q in asked])
            rows = [(q["query_id"], i, s, None, None) for q, (ids, best) in zip(asked, got, strict=True) for i, s in zip(ids.tolist(), best.tolist(), strict=True)]
            if rows:
                yield _emit(rows, HITS)


def graph_search(index: DataFrame, queries: DataFrame, k: int, beam: int = 128) -> DataFrame:
    """query_id, id, score, rank by inner product, found by a beam on every shard; queries (query_id, vec[, facets]).

    Approximate: rows the beams do not reach are missed; those found have their exact scores. Queries far from
    all rows need a wider beam (vectors of one normal distribution in 64 dimensions, queries of another: 0.75 of
    the 20 best at 128, where queries near the rows find 0.99)."""
    asked = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"), _facets(queries).alias("facets")).filter("vec is not null")
    packs, groups = _packs(asked, ["vec", "facets"], index.select("shard").distinct())
    none = F.lit(None)
    nodes = [f.name for f in index.schema.fields]
    kind = packs.schema["asked"].dataType
    own = index.select(_teams(groups), *nodes, F.lit(0).alias("kind"), none.cast(kind).alias("asked"))
    packs = packs.select("team", "shard", *[none.cast(index.schema[c].dataType).alias(c) for c in nodes[1:]], F.lit(1).alias("kind"), "asked")
    both = own.unionByName(packs).withColumn("place", F.col("shard").cast("long") * groups + F.col("team"))  # what one task takes
    met = both.select("place", *nodes, "kind", "asked").repartition(_parts(index), "place").sortWithinPartitions("place", "kind", "id")
    hits = met.mapInArrow(partial(_search_graph, max(k, 1), max(beam, k)), HITS)
    return top_k(hits.select("query_id", "id", "score"), "query_id", "score", k, ["id"])
