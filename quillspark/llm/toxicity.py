"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and their 4- and 5-letter beginnings. The labelled examples stand in an
inverted index cut into blocks of BLOCK examples; each term keeps the greatest weight it has in each
block, so a query's bound for a block is one product, and blocks are opened by falling bound until
the K-th best cosine cannot be beaten: the neighbours are exact (ties: the smaller example). Their
votes, weighted by cosine over distance (1 - cosine + near) and smoothed towards the base rate, are
mapped to probabilities by isotonic regression over leave-one-out votes, each class weighted by its
count over all labelled rows. Scores come with their evidence: the neighbours' ids, cosines and labels.

fit() reads a bounded sample of labelled examples: up to per_class documents of either label and at most
max_chars characters, drawn by a hash of the id. All terms the sample ties to a label are indexed (shares
e^odds times apart or more, in at least df_least examples, and so unevenly that chance would give less than
one such term among all: exact binomial tails); other words do not enter the vectors. Their document
frequencies are counted over all documents that have a text, labelled or not.

The form (odds, near and the smoothing) is chosen by fit() itself: of FORMS the one with the least log loss in
cross-validation over FOLDS parts of the examples, terms and calibration learned anew without each part. The
parts are dealt by a hash of the id; no other row takes part. With under 2 * FOLDS examples of a label it is
the first form.

Null and empty texts and texts with no kept term get the calibrated score of such examples. Repeated rows
come as often as they are there; of rows of one id the first text in order is the example. Without
any labelled row every score is 0. Of repeated labels of one document the larger counts.
"""

from __future__ import annotations

import logging
import math
import re
import zlib
from collections import Counter
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

K, BLOCK, FOLDS = 15, 64, 5
LOG = logging.getLogger(__name__)
_WORD = re.compile(r"[^\W\d_]+")
MAX_SEEN = 300_000


class Form(NamedTuple):
    """How far apart a term's shares have to be, what is added to a distance, how much the base rate weighs."""

    odds: float = 2.0
    near: float = 0.1
    smooth: float = 0.3


FORMS = tuple(Form(*x) for x in product((2.0, 1.5, 2.5), (0.1, 0.05, 0.3), (0.3, 1.0)))


def terms_of(token: str) -> list[str]:
    """Terms of one blank-separated token of a lower-cased text."""
    out = []
    for w in _WORD.findall(token):
        out.append(w)
        out += [f"{w[:n]}-" for n in (4, 5) if len(w) > n]
    return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising x and the non-falling weighted means of y at them."""
    at = np.unique(x)
    pos = np.searchsorted(at, x)
    ws, ys = np.bincount(pos, w), np.bincount(pos, w * y)
    stack: list[list[float]] = []
    for i in range(len(at)):
        stack.append([ys[i], ws[i], 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            y1, w1, n1 = stack.pop()
            stack[-1] = [stack[-1][0] + y1, stack[-1][1] + w1, stack[-1][2] + n1]
    return at, np.concatenate([np.full(int(n), a / b) for a, b, n in stack]) if stack else np.zeros(0)


def chance(hits: int, n: int, q: float) -> float:
    """The probability of a count as far from n * q as hits, on its side, if each of n hits with probability q."""
    if hits < n * q:
        hits, q = n - hits, 1 - q
    most = math.lgamma(n + 1)
    return math.fsum(math.exp(most - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(q) + (n - k) * math.log1p(-q)) for k in range(hits, n + 1))


class NearestExamples:
    """The index and its calibration; picklable, its size bounded by the sample."""

    def __init__(self, ids, texts, labels, class_rows=None, df_least=4, counted=None, form: Form = FORMS[0]):
        """counted: from a dict of terms to the number of documents and each term's frequency among them
        (None: those of the examples)."""
        labels = np.array(labels, dtype=np.int64)
        bags = [Counter(t for tok in text.lower().split() for t in terms_of(tok)) for text in texts]
        self.form = form
        self.seen: dict[str, tuple] = {}
        n1, n0 = int(labels.sum()), int((1 - labels).sum())
        df1, df0 = Counter(), Counter()
        for bag, label in zip(bags, labels, strict=True):
            (df1 if label else df0).update(bag.keys())
        chosen, known = [], [t for t in df1.keys() | df0.keys() if df1[t] + df0[t] >= df_least] if n1 and n0 else []
        for t in known:
            df = df1[t] + df0[t]
            odds = abs(math.log((df1[t] + 0.5) / (n1 + 1)) - math.log((df0[t] + 0.5) / (n0 + 1)))
            if odds >= form.odds:
                by_chance = chance(df1[t], df, n1 / (n1 + n0))
                if by_chance * len(known) < 1:
                    chosen.append((by_chance, t, df))
        chosen.sort()
        self.terms = {t: i for i, (_, t, _) in enumerate(chosen)}
        n_docs, dfs = counted(self.terms) if counted and chosen else (len(bags), [df for _, _, df in chosen])
        self.idf = np.array([math.log((1 + n_docs) / df) + 1 for df in dfs])
        vectors = [self._weigh({self.terms[t]: c for t, c in bag.items() if t in self.terms}) for bag in bags]
        # like examples side by side, so that block bounds are tight
        order = sorted(range(len(bags)), key=lambda i: (-labels[i], int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, ids[i]))
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.labels = labels[order]
        self._index([vectors[i] for i in order])
        rows1, rows0 = class_rows or (n1, n0)
        self.base = (rows1 + 0.5) / (rows1 + rows0 + 1) if n1 else 0.0
        self.weight = rows0 / max(1, n0), rows1 / max(1, n1)
        self.others = [self.neighbours(*vectors[i], skip=k) for k, i in enumerate(order)]
        self.calibrate(form)

    def calibrate(self, form: Form) -> None:
        """From the examples' votes without themselves to probabilities."""
        self.form = form
        votes = np.array([self._share(*x) for x in self.others]) if self.others else np.zeros(0)
        weight = np.where(self.labels == 1, self.weight[1], self.weight[0])
        # a row of either label at either end keeps scores inside 0 and 1
        x, y, w = np.append(votes, [1.0, 0.0]), np.append(self.labels, [1, 0]), np.append(weight, [1.0, 1.0])
        self.cal = isotonic(x, y, w) if self.labels.any() else (np.zeros(1), np.zeros(1))

    def _weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), dtype=np.int64)
        w = np.array([1 + math.log(counts[i]) for i in at.tolist()]) * self.idf[at] if len(at) else np.zeros(0)
        norm = math.sqrt(float((w * w).sum()))
        return at, w / norm if norm else w

    def _index(self, vectors) -> None:
        n, self.blocks = len(self.terms), -(-len(vectors) // BLOCK)
        owner = np.concatenate([np.full(len(v[0]), d) for d, v in enumerate(vectors)]) if vectors else np.zeros(0, np.int64)
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        value = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((owner, term))
        self.post_doc, self.post_val, term = owner[order].astype(np.int64), value[order], term[order].astype(np.int64)
        self.top = np.zeros((n, max(1, self.blocks)))
        np.maximum.at(self.top, (term, self.post_doc // BLOCK), self.post_val)
        cell = term * max(1, self.blocks) + self.post_doc // BLOCK
        self.cells = np.searchsorted(cell, np.arange(n * max(1, self.blocks) + 1))

    def neighbours(self, at: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Exact K nearest examples with a positive cosine: positions and cosines, best first."""
        if not len(at) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = w @ self.top[at]
        found_at, found = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(found) == K and bound[b] < found[-1] - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, q in zip(at.tolist(), w.tolist(), strict=True):
                c = t * self.blocks + b
                i, j = self.cells[c], self.cells[c + 1]
                if j > i:
                    score[self.post_doc[i:j] - b * BLOCK] += q * self.post_val[i:j]
            if b * BLOCK <= skip < (b + 1) * BLOCK:
                score[skip - b * BLOCK] = 0
            own = np.flatnonzero(score > 0)
            all_at, all_s = np.concatenate([found_at, own + b * BLOCK]), np.concatenate([found, score[own]])
            best = np.lexsort((all_at, -np.round(all_s, 12)))[:K]
            found_at, found = all_at[best], all_s[best]
        return found_at, found

    def _share(self, who: np.ndarray, cos: np.ndarray) -> float:
        """The toxic share of the neighbours' votes; near ones weigh more."""
        vote = cos / (1 - cos + self.form.near)
        return float((vote @ self.labels[who] + self.form.smooth * self.base) / (vote.sum() + self.form.smooth))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        seen, counts = self.seen, Counter()
        for token in text.lower().split():
            try:
                hit = seen[token]
            except KeyError:
                if len(seen) > MAX_SEEN:
                    seen.clear()
                hit = tuple(self.terms[t] for t in terms_of(token) if t in self.terms)
                if len(token) <= 64:
                    seen[token] = hit
            if hit:
                counts.update(hit)
        return self._weigh(counts)

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        """The score and its evidence: positions and cosines of the neighbours, best first."""
        at, w = self.vector(text or "")
        who, cos = self.neighbours(at, w)
        p = float(np.interp(self._share(who, cos), *self.cal))
        return min(1.0, max(0.0, p)), who, cos

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "others": []}  # scoring needs neither


def fold_losses(sample: list[tuple], class_rows: tuple[int, int], odds: float, fold: int) -> list[tuple[Form, float]]:
    """The log loss of one part of the examples (id, text, label) under all forms of these odds, learned from the
    other parts; each label weighs as its rows do."""
    mine = [zlib.crc32(f"fold {i}".encode()) % FOLDS == fold for i, _, _ in sample]
    rest, own = [x for x, m in zip(sample, mine, strict=True) if not m], [x for x, m in zip(sample, mine, strict=True) if m]
    m = NearestExamples(*map(list, zip(*rest, strict=True)), class_rows=class_rows, form=next(f for f in FORMS if f.odds == odds))
    near = [m.neighbours(*m.vector(text)) for _, text, _ in own]
    out = []
    for form in (f for f in FORMS if f.odds == odds):
        m.calibrate(form)
        p = np.clip([np.interp(m._share(*x), *m.cal) for x in near], 1e-4, 1 - 1e-4)
        y = np.array([label for _, _, label in own])
        out.append((form, float((np.where(y == 1, m.weight[1], m.weight[0]) * -np.log(np.where(y == 1, p, 1 - p))).sum())))
    return out


def chosen_form(spark, sample: list[tuple], class_rows: tuple[int, int]) -> Form:
    """The form of the least cross-validated log loss (the first of equal ones); a task for each fold and odds."""
    n1 = sum(label for _, _, label in sample)
    if min(n1, len(sample) - n1) < 2 * FOLDS:
        return FORMS[0]
    held = spark.sparkContext.broadcast((sample, class_rows))
    work = [(odds, fold) for odds in dict.fromkeys(f.odds for f in FORMS) for fold in range(FOLDS)]

    def run(batches):
        for batch in batches:
            got = [x for odds, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in fold_losses(*held.value, odds, fold)]
            yield pa.RecordBatch.from_arrays([pa.array([FORMS.index(f) for f, _ in got], pa.int32()), pa.array([x for _, x in got], pa.float64())], names=["form", "loss"])

    rows = spark.createDataFrame(work, "odds double, fold int").repartition(len(work), "odds", "fold")
    loss: Counter = Counter()
    for r in sorted(rows.mapInArrow(tidy(run), "form int, loss double").collect()):  # a row for each form and fold
        loss[r["form"]] += r["loss"]
    return FORMS[min(loss, key=lambda k: (loss[k], k))]


def document_frequencies(docs: DataFrame, terms: dict[str, int], text_col: str = "text") -> tuple[int, list[int]]:
    """The number of non-null texts of docs and, for each term, the number of those that hold it."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        index, seen, n = held.value, {}, 0
        counts = np.zeros(len(index), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is None:
                    continue
                n += 1
                own: set[int] = set()
                for token in set(text.lower().split()):
                    try:
                        hit = seen[token]
                    except KeyError:
                        if len(seen) > MAX_SEEN:
                            seen.clear()
                        hit = tuple(index[t] for t in terms_of(token) if t in index)
                        if len(token) <= 64:
                            seen[token] = hit
                    if hit:
                        own.update(hit)
                counts[list(own)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *counts[at].tolist()], pa.int64())], names=["term", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(run), "term long, n long")
    found = dict(rows.groupBy("term").agg(F.sum("n")).collect())
    return found.get(-1, 0), [found.get(i, 0) for i in range(len(terms))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500, max_chars: int = 50_000) -> NearestExamples:
    """Learn from labelled documents; labels has the rows that may be learned from, once or more."""
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    rows = dict(known.groupBy("y").count().collect())
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter(F.length("t") <= max_chars)
    found = texts.join(F.broadcast(picked), "i").collect()  # at most 2 * per_class ids
    first: dict = {}
    for r in sorted(found, key=lambda r: (r["i"], r["t"])):
        first.setdefault(r["i"], r)
    sample = [(r["i"], r["t"], r["y"]) for r in first.values()]
    ids, own, y = (list(x) for x in zip(*sample, strict=True)) if sample else ([], [], [])
    class_rows = rows.get(1, 0), rows.get(0, 0)
    form = chosen_form(docs.sparkSession, sample, class_rows)
    LOG.info("form of the least cross-validated loss: %s", form)
    return NearestExamples(ids, own, y, class_rows, counted=lambda terms: document_frequencies(docs, terms, text_col), form=form)


def score_toxicity(df: DataFrame, model: NearestExamples, text_col: str = "text", evidence: bool = True) -> DataFrame:
    """df with score double, predicted int and evidence array<struct<doc_id, cosine, label>>.

    Existing columns of these names, in any case, are replaced.
    """
    added = ["score", "predicted", *(["evidence"] if evidence else [])]
    rest = [c for c in df.columns if c.lower() not in added]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "score double, predicted int", *(["evidence array<struct<doc_id:bigint,cosine:double,label:int>>"] if evidence else [])])
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            got = [m.score(t) for t in batch.column(batch.schema.names.index(text_col)).to_pylist()]
            cols = [pa.array([s for s, _, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _, _ in got], pa.int32())]
            if evidence:
                who, cos = np.concatenate([w for _, w, _ in got]), np.concatenate([c for _, _, c in got])
                ends = pa.array(np.cumsum([0, *(len(w) for _, w, _ in got)]), pa.int32())
                parts = [pa.array(m.ids[who]), pa.array(cos), pa.array(m.labels[who], pa.int32())]
                cols.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["doc_id", "cosine", "label"])))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in rest), *cols], names=[*rest, *added])

    return df.select(*rest).mapInArrow(tidy(run), schema)
