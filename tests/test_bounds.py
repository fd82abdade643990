"""What tasks hold and shuffle is bounded: searches some rows at a time, batches by bytes, texts cleaned once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.llm import tokens as T
from quillspark.operators import anchors as A
from quillspark.operators import chunking as K
from quillspark.operators import metrics as M
from quillspark.operators import tables
from quillspark.operators import vector as V
from quillspark.operators.providers import LexicalEncoder, words


def test_best_keeps_ties_over_many_parts():
    rng = np.random.default_rng(1)
    s = np.round(rng.random((7, 400)), 2)  # many equal scores
    s[:, 3] = np.nan
    ids = rng.permutation(400)
    best = V._Best(np.arange(7) * 10, 5)
    for lo in range(0, 400, 13):
        best.add(ids[lo : lo + 13], s[:, lo : lo + 13])
        assert len(best.row) <= 7 * 5
    (out,) = best.batches()
    want = [(10 * i, int(ids[j]), s[i, j]) for i in range(7) for j in np.lexsort((ids, -s[i]))[:5]]
    assert list(zip(*(c.to_pylist() for c in out.columns), strict=True)) == want


def test_dense_search_scores_few_cells_at_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(V, "CELLS", 64)
    add = V._Best.add
    monkeypatch.setattr(V._Best, "add", lambda self, ids, s, above=None: (seen.append(s.size), add(self, ids, s, above))[1])
    rng = np.random.default_rng(3)
    vec = np.round(rng.standard_normal((50, 4)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<double>")
    got = V.dense_search(df.filter("id < 8").select(F.col("id").alias("query_id"), "vec"), df, 6).collect()
    s = np.round(vec[:8] @ vec.T, 6)
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == {(q, k + 1): int(i) for q in range(8) for k, i in enumerate(np.lexsort((np.arange(50), -s[q]))[:6])}
    best = V._Best(np.arange(2), 1)
    best.add(np.arange(3), np.zeros((2, 3)))
    assert seen == [6] and best.ids.tolist() == [0, 0]


def test_text_search_shuffles_hits_only(spark):
    texts = ["a b b c", "", None, "c c c d", "x", "b a", "a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(1, "a", 1.0), (1, "c", 2.0), (2, "b", 1.0), (3, "none", 1.0)], "query_id long, token string, weight double")
    own = docs.select("id", F.explode(words(F.col("text"))).alias("token")).groupBy("id", "token").agg((1 + F.log(F.count("*").cast("double"))).alias("weight"))
    got = V.text_search(asked, docs, words(F.col("text")), 2)
    key = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    assert key(got) == key(V.sparse_search(asked, own, 2)) and len(key(got)) == 4
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().toString() and "collect_list" not in got._jdf.queryExecution().toString()


def test_batches_are_small_in_bytes(spark):
    from quillspark.plans.queries import t

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    t(spark, "/root/testdata/sf0.001", "pages")
    assert spark.conf.get(key) == str(tables.BATCH_BYTES)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    got = [r["n"] for r in spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t")).mapInArrow(sizes, "n long").collect()]
    assert len(got) > 2 and max(got) < 1.5 * tables.BATCH_BYTES


def test_pairs_are_cleaned_once(spark):
    df = spark.createDataFrame([(1, "1、问：Where is it now？答：It is on the upper shelf")], "id long, text string")
    plan = K.qa_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 40, plan.count("regexp_replace")


def test_tokenizer_cuts_few_characters_at_once():
    assert T.BATCH_CHARS <= 500_000


class _Table:
    """Stands for a table: gives back what would run on its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_short_texts_are_hashed_together(monkeypatch):
    """Runs are those of each text by itself, none lies across two, and the steps do not grow with the texts."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab \n\u3000\U0001f600"), n)) for n in rng.integers(0, 90, 400)] + ["", None, " ", "a" * 300]
    calls, plain = [], A._runs
    monkeypatch.setattr(A, "_runs", lambda chars, k: (calls.append(k), plain(chars, k))[1])
    batch = lambda lo, hi: pa.record_batch([pa.array(range(lo, hi), pa.int64()), pa.array(texts[lo:hi], pa.string())], names=["owner", "text"])
    rows = lambda out: sorted(tuple(r.values()) for b in out for r in b.to_pylist())
    for classes in (list(A.CLASSES), None):
        run = A._runs_of(_Table(), classes)
        apart = rows(out for i in range(len(texts)) for out in run([batch(i, i + 1)]))
        calls.clear()
        assert rows(run([batch(0, len(texts))])) == apart and len(apart) > 400
        assert len(calls) < 20
        monkeypatch.setattr(A, "CHARS", 100)
        assert rows(run([batch(0, len(texts))])) == apart
        monkeypatch.setattr(A, "CHARS", 250_000)


def test_texts_are_not_shuffled_to_meet_evidence(spark):
    texts = spark.createDataFrame([(i, f"text {i} " + "the quick brown fox jumps over the lazy dog again and again " * (i % 3 == 0)) for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, "no text has this evidence at all, it is long")], "item_id long, evidence string")
    found = M.gold_pairs(items, texts)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, 1) for i in range(0, 30, 3)}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_documents_with_evidence_are_cut(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "b2"), (3, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(2, 7), (2, 8), (None, 7)], "doc_id long, item_id long")
    assert sorted(r["text"] for r in M.holders(pairs, docs).collect()) == ["b", "b2", "c"]


def test_hybrid_search_reads_texts_once(spark, monkeypatch):
    """Both legs' hits are those of the two searches, many small parts or one; texts are read once, words are not shuffled."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "cc", "dd", "e\u0301e", "Zz", "f1"], n)) for n in rng.integers(0, 12, 60)] + ["", None, " .,", "x"]
    docs = spark.createDataFrame([(i * 3, x) for i, x in enumerate(texts)], "id long, text string")
    asked = spark.createDataFrame([(1, "a cc cc"), (2, "zz, b"), (3, "none"), (4, "..."), (5, None), (6, "F1 a x")], "query_id long, text string")
    encoder = LexicalEncoder(16)
    vec = X.let(encoder.dense(F.col("text")), V.normalised).alias("vec")
    tokens = asked.select("query_id", F.explode(encoder.sparse(F.col("text"))).alias("w")).select("query_id", "w.token", "w.weight")
    key = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    sparse, dense = key(V.text_search(tokens, docs, words(F.col("text")), 4)), key(V.dense_search(asked.select("query_id", vec), docs.select("id", vec), 4))
    for block in (500, 2):
        got = V.hybrid_search(asked, docs, encoder, 4, block).cache()
        assert key(got.filter("leg = 'sparse'")) == sparse and key(got.filter("leg = 'dense'")) == dense
    assert len(sparse) > 8 and len(dense) == 20
    plan = V.hybrid_search(asked, docs, encoder, 4)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("MapInArrow") == 1 and plan.optimizedPlan().toString().count("split(") == 1


def test_fusion_writes_no_index(spark, monkeypatch):
    from quillspark.operators import index
    from quillspark.plans import queries

    monkeypatch.setattr(index, "text_index", None)
    assert queries.rrf_fusion(spark, "/root/testdata/sf0.001").filter("rank = 1").count() > 0


def test_weighed_rows_are_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    matrix = rng.random((5, 3))
    owner, line = np.repeat(np.arange(40), 4), rng.integers(-1, 5, 160)
    weights = rng.random(160)
    hits = []
    for cells, gathered in ((V.CELLS, V.GATHERED), (9, 6), (30, 3), (3, 1000)):
        monkeypatch.setattr(V, "CELLS", cells)
        monkeypatch.setattr(V, "GATHERED", gathered)
        best = V._Best(np.arange(3), 5)
        V._add_weighed(best, np.arange(40) + 7, matrix, owner, line, weights)
        hits.append([c.to_pylist() for b in best.batches() for c in b.columns])
    assert hits[0] == hits[1] == hits[2] == hits[3] and len(hits[0][0]) == 15
