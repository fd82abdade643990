"""Stored indexes against exhaustive search: postings exactly, graphs by recall; filters, ties, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import index as I
from quillspark.operators import vector as V
from quillspark.operators.providers import words

SF = "/root/testdata/sf0.01"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def weights(df, key, name):
    w = df.select(F.col(key).alias(name), F.explode(words(F.col("text"))).alias("token"))
    return w.groupBy(name, "token").agg((1 + F.log(F.count("*").cast("double"))).alias("weight"))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")


@pytest.fixture(scope="module")
def asked(spark):
    return weights(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "query_id").persist()


HIT = ("query_id", "id", "score", "rank")


def test_postings_give_the_hits_of_a_scan_and_read_less(spark, texts, asked):
    index = I.text_index(texts, words(F.col("text")), shard_chars=300_000)
    assert index.select("shard").distinct().count() > 5
    assert rows(I.sparse_index_search(index, asked, 20), *HIT) == rows(V.sparse_search(asked, weights(texts, "id", "id"), 20), *HIT)
    traffic = I.postings_read(I.text_index(texts, words(F.col("text"))), asked, 5).first()
    assert 0 < traffic["n_read"] < 0.7 * traffic["n_stored"]


def test_postings_of_any_weights(spark):
    rng = np.random.default_rng(3)
    doc = [(int(i), f"t{t}", float(rng.choice([-2.0, -0.5, 0.25, 1.0, 3.0])), int(i) % 3) for i in range(400) for t in rng.choice(40, 6, replace=False)]
    q = [(int(i), f"t{t}", float(rng.choice([-1.0, 0.5, 2.0])), [int(i) % 3] if i % 2 else None) for i in range(60) for t in rng.choice(45, 5, replace=False)]
    docs = spark.createDataFrame([*doc, (None, "t1", 9.0, 0), (5000, None, 9.0, 0)], "id long, token string, weight double, facet int")
    queries = spark.createDataFrame(q, "query_id long, token string, weight double, facets array<int>")
    weight = {(i, t): w for i, t, w, _ in doc}
    want = []
    for i in range(60):
        own, seen = [(t, w) for j, t, w, _ in q if j == i], next(f for j, _, _, f in q if j == i)
        score = {d: round(sum(w * weight.get((d, t), 0.0) for t, w in own), 6) for d in range(400) if seen is None or d % 3 in seen}
        best = sorted((-s, d) for d, s in score.items() if s > 0)[:7]
        want += [(i, d, -s, r + 1) for r, (s, d) in enumerate(best)]
    got = rows(I.sparse_index_search(I.sparse_index(docs, shard_postings=500), queries, 7), *HIT)
    assert got == sorted(want)


def test_indexes_of_nothing(spark):
    empty = I.text_index(spark.createDataFrame([(None, "x"), (1, None)], "id long, text string"), words(F.col("text")))
    q = spark.createDataFrame([(1, "a", 1.0)], "query_id long, token string, weight double")
    assert rows(I.sparse_index_search(empty, q, 5), *HIT) == []
    some = I.text_index(spark.createDataFrame([(1, ""), (2, "a b"), (3, "a")], "id long, text string"), words(F.col("text")))
    assert rows(I.sparse_index_search(some, q, 5), *HIT) == [(1, 2, 1.0, 1), (1, 3, 1.0, 2)]
    assert rows(I.sparse_index_search(some, q.limit(0), 5), *HIT) == []
    graph = I.graph_index(spark.createDataFrame([(1, None)], "id long, vec array<double>"))
    assert rows(I.graph_search(graph, spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>"), 5), *HIT) == []
    one = I.graph_index(spark.createDataFrame([(7, [1.0, 0.0])], "id long, vec array<double>"))
    assert rows(I.graph_search(one, spark.createDataFrame([(1, [0.5, 1.0]), (2, None)], "query_id long, vec array<double>"), 5), *HIT) == [(1, 7, 0.5, 1)]


def vectors(spark, n, seed=1, groups=30):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 24)) * 3
    x = centre[rng.integers(groups, size=n)] + rng.normal(size=(n, 24))
    x[: n // 10] *= 4  # lengths differ, as the measure is the inner product
    return x, spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "id long, vec array<double>, facet int")


@pytest.mark.parametrize("shard", [700, 20_000])
def test_graph_finds_nearly_all(spark, shard):
    x, df = vectors(spark, 3000)
    index = I.graph_index(df, shard_vectors=shard)
    assert sorted(r["id"] for r in index.select("id").collect()) == list(range(3000))  # every row is in it
    assert index.select("shard").distinct().count() == -(-3000 // shard)
    rng = np.random.default_rng(9)
    q = x[::60] + rng.normal(size=(50, 24)) * 0.3
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>")
    got = rows(I.graph_search(index, asked, 20), *HIT)
    want = rows(V.dense_search(asked, df, 20), *HIT)
    exact = {(a, b): s for a, b, s, _ in want}
    assert len(exact.keys() & {(a, b) for a, b, _, _ in got}) >= 0.95 * len(want)
    assert all(s == round(float(q[a] @ x[b]), 6) for a, b, s, _ in got)


def test_graph_with_filters(spark):
    x, df = vectors(spark, 2500, seed=4)
    index = I.graph_index(df)
    q = x[::50]
    seen = [[0], [1, 2, 3, 4, 5, 6], None, [99]]
    asked = spark.createDataFrame([(i, v.tolist(), seen[i % 4]) for i, v in enumerate(q)], "query_id long, vec array<double>, facets array<int>")
    got = rows(I.graph_search(index, asked, 10), *HIT)
    want = set()
    for i, v in enumerate(q):
        score = np.round(x @ v, 6)
        ids = [j for j in range(2500) if seen[i % 4] is None or j % 7 in seen[i % 4]]
        want |= {(i, j) for j in sorted(ids, key=lambda j: (-score[j], j))[:10]}
    pairs = {(a, b) for a, b, _, _ in got}
    assert all(seen[a % 4] is None or b % 7 in seen[a % 4] for a, b in pairs)
    assert len(pairs & want) >= 0.95 * len(want)


def test_hybrid_search_with_filters_in_both_legs(spark, texts):
    """RRF of both indexes equals RRF of exhaustive legs over the rows that may be seen."""
    from quillspark.operators.providers import LexicalEncoder

    facet = F.ascii(F.right("lang", F.lit(1)))
    docs = texts.withColumn("facet", facet).withColumn("vec", V.normalised(LexicalEncoder(32).dense(F.col("text"))))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    seen = F.array(F.ascii(F.lit("n")), F.ascii(F.lit("r"))).alias("facets")
    q = items.select(F.col("item_id").alias("query_id"), V.normalised(LexicalEncoder(32).dense(F.col("text"))).alias("vec"))
    words_asked = weights(items, "item_id", "query_id")
    open_docs = docs.filter(facet.isin(ord("n"), ord("r")))
    legs = [
        I.sparse_index_search(I.text_index(docs, words(F.col("text"))), words_asked.select("*", seen), 20),
        I.graph_search(I.graph_index(docs), q.select("*", seen), 20, beam=128),
    ]
    exact = [V.sparse_search(words_asked, weights(open_docs, "id", "id"), 20), V.dense_search(q, open_docs, 20)]
    got, want = set(rows(V.rrf(legs, 20), "query_id", "id")), set(rows(V.rrf(exact, 20), "query_id", "id"))
    assert len(got & want) >= 0.95 * len(want)
