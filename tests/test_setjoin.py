"""Similarity joins against all pairs: sets of all sizes, ties, repeated rows, keys dealt over a grid."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dedup as D
from quillspark.operators import setjoin as J

KIND = "side int, id long, codes array<long>"


def families(seed, n):
    """Sets around some centres, of 1 to 400 elements out of few, and copies."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        size = int(rng.choice([1, 2, 3, 5, 8, 20, 60, 200, 400]))
        base = rng.choice(1500, size, replace=False)
        for _ in range(rng.integers(1, 7)):
            keep = base[rng.random(size) > rng.choice([0, 0.05, 0.1, 0.2])]
            more = rng.choice(1500, int(rng.integers(0, 1 + size // 8)), replace=False)
            out.append(sorted({int(x) - 700 for x in np.concatenate([keep, more])}))
    return [s for s in out if s]


def jaccard(x, y):
    i = len(set(x) & set(y))
    return i / (len(x) + len(y) - i)


@pytest.mark.parametrize(("part", "codes"), [(20_000, 1_000_000), (40, 0)])
@pytest.mark.parametrize("t", [0.5, 0.8])
def test_pairs_of_one_table(spark, monkeypatch, part, codes, t):
    monkeypatch.setattr(J, "PART", part)
    monkeypatch.setattr(J, "MOST_CODES", codes)
    sets = families(int(t * 10), 90)
    want = {(a, b): round(jaccard(sets[a], sets[b]), 6) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jaccard(sets[a], sets[b]) >= t}
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sets)], KIND)
    got = J.similar_pairs(J.ordered(df), t).collect()
    assert len(got) == len(want) > 50 and {(r["a"], r["b"]): r["jaccard"] for r in got} == want


def test_pairs_of_two_tables(spark):
    sets = families(5, 70)
    side = [i % 2 for i in range(len(sets))]
    ids = [i // 2 for i in range(len(sets))]  # both sides use the same ids
    want = {(ids[x], ids[y]): round(jaccard(sets[x], sets[y]), 6) for x in range(len(sets)) for y in range(len(sets)) if side[x] == 0 and side[y] == 1 and jaccard(sets[x], sets[y]) >= 0.8}
    df = spark.createDataFrame(list(zip(side, ids, sets, strict=True)), KIND)
    got = J.similar_pairs(J.ordered(df), 0.8, two_sided=True).collect()
    assert len(got) == len(want) > 20 and {(r["a"], r["b"]): r["jaccard"] for r in got} == want
    assert J.similar_pairs(J.ordered(df.limit(0)), 0.8).count() == 0


def test_near_pairs_of_texts(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", "ab", "abc", "ABC!", "a b c", "\U0001f600\U0001f601\U0001f602", "x" * 5000, "x" * 40]
    for _ in range(60):
        base = list(rng.choice(list("abcdefg hijkÄß漢字"), int(rng.integers(10, 90))))
        texts.append("".join(base))
        base[int(rng.integers(len(base)))] = "z"
        texts.append("".join(base))

    def grams(x):
        x = "".join(c for c in x or "" if c.isalnum() or c == "_").lower()
        return {x[i : i + 3] for i in range(len(x) - 2)}

    g = [grams(x) for x in texts]
    # emoji are neither letters nor digits
    want = {(a, b) for a in range(len(g)) for b in range(a + 1, len(g)) if g[a] and g[b] and jaccard(g[a], g[b]) >= 0.8}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {(r["a"], r["b"]) for r in D.near_pairs(df, "id", F.col("text")).collect()} == want
    both = D.near_pairs(df.filter("id < 60"), "id", F.col("text"), other=df.filter("id >= 50"), other_text=F.col("text")).collect()
    assert {(r["a"], r["b"]) for r in both} == {(a, b) for a in range(60) for b in range(50, len(g)) if g[a] and g[b] and jaccard(g[a], g[b]) >= 0.8}


def test_copies_are_compared_once(spark, monkeypatch):
    seen = []
    pairs = D.similar_pairs
    monkeypatch.setattr(D, "similar_pairs", lambda sets, *a, **k: (seen.append(sets.count()), pairs(sets, *a, **k))[1])
    df = spark.createDataFrame([(i, "the same words again" if i % 2 else "the same words again!?" if i % 3 else f"{i} other {i * i} words {i**3}") for i in range(90)], "id long, text string")
    got = D.near_pairs(df, "id", F.col("text"))
    same = 90 - 15  # those of equal form
    assert got.filter("jaccard = 1").count() == same * (same - 1) // 2
    assert seen == [16]


def test_few_elements_and_pairs_are_held_at_once(spark, monkeypatch):
    monkeypatch.setattr(J, "ELEMENTS", 50)
    rows = spark.createDataFrame([(i, f"text {i} with some words of its own {i * i}") for i in range(40)], "id long, text string").coalesce(1)
    assert list(J.runs(np.array([30, 30, 60, 0, 10]), 50)) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    sets = J.coded_ngrams(rows, "id", F.col("text"))
    assert sets.count() == 40 and sets.select("mark").distinct().count() == 40
    # one key of many equal sets: what is found leaves in parts
    monkeypatch.setattr(J, "AT_ONCE", 100)
    n = 60
    one = np.zeros(2 * n, np.int64)
    batch = {"code": one, "step": one, "px": one, "py": one, "kind": np.repeat([0, 1], n), "side": one, "id": np.tile(np.arange(n), 2), "n": one + 5, "at": one} | {f"s{i}": one for i in range(J.WORDS)}
    out = list(J._met(0.8, False)([pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in batch.items()})]))
    assert len(out) > 5 and max(b.num_rows for b in out) <= 250
    assert {p for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} == {(a, b) for a in range(n) for b in range(a + 1, n)}
