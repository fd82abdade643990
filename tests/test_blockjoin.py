"""The join by blocks against all pairs: codes of every width, sizes of their own blocks, few sets at once; what it shuffles."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import blockjoin as B
from quillspark.operators import dedup as D
from quillspark.plans.queries import QUERIES


def jaccard(x, y):
    i = len(set(x) & set(y))
    return i / (len(x) + len(y) - i)


def families(seed, n, code=lambda c: c):
    """Sets of one size or of many around some centres, most of them of the same frequent elements."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        base = rng.choice(600, int(rng.choice([1, 2, 9, 40, 40, 40, 200, 400])), replace=False)
        for _ in range(rng.integers(1, 6)):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.08, 0.15])]
            out.append(sorted({code(int(x)) for x in keep} | {code(int(x)) for x in rng.choice(600, len(base) // 20, replace=False)}))
    return [s for s in out if s]


@pytest.mark.parametrize("width", [1, 4, 8])
def test_codes_as_bytes(width):
    rng = np.random.default_rng(width)
    sets = [np.unique(rng.integers(0, {1: 65_536, 4: 2**31, 8: 2**62}[width], int(n))) for n in [0, *rng.integers(0, 500, 30), 0]]
    flat, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    raw, at = B._packed(flat, offsets, width)
    column = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.tobytes())])
    for lo, k in ((0, len(sets)), (5, 9)):
        got, ends = B._unpacked(column.slice(lo, k), width)
        assert (got == flat[offsets[lo] : offsets[lo + k]]).all() and (ends == offsets[lo : lo + k + 1] - offsets[lo]).all()


def local(sets, t, width, held, others, pairs):
    """_sent and _joined of one task in this process: ids of the sets that are held and of those that meet them."""

    def rows(ids, kind):
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([sets[i] for i in ids], pa.list_(pa.int64()))], names=["id", "codes"])
        place = {len(s): (0, 1) for s in sets}
        return pa.concat_tables([pa.Table.from_batches([b]) for b in B._sent(place, {0: [(0, kind)]}, width)([batch])]).sort_by("n")

    both = pa.concat_tables([rows(held, 0), rows(others, 1)]).combine_chunks()
    return list(B._joined(t, width, frozenset([0]) if held == others else frozenset(), pairs)(both.to_batches(max_chunksize=37)))


@pytest.mark.parametrize(("width", "code"), [(1, lambda c: c), (4, lambda c: c * 3_000_000), (8, lambda c: c * 2**50 - 300 * 2**50)])
def test_few_sets_and_marks_at_once(monkeypatch, width, code):
    for name, value in (("LINES", 7), ("CELLS", 90), ("HEAD", 64), ("MARKS", 1 << 12)):
        monkeypatch.setattr(B, name, value)
    sets = families(width, 40, code)
    ids = list(range(len(sets)))
    want = {(a, b): round(jaccard(sets[a], sets[b]), 6) for a in ids for b in ids[a + 1 :] if jaccard(sets[a], sets[b]) >= 0.8}
    got = [r for b in local(sets, 0.8, width, ids, ids, True) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(got) == len(want) > 40 and {(a, b): j for a, b, j in got} == want
    first, last = ids[: len(ids) // 2], ids[len(ids) // 2 - 9 :]  # some are on both sides: none meets itself
    seen = [x for b in local(sets, 0.8, width, first, last, False) for x in b.column(0).to_pylist()]
    assert set(seen) == {b for b in last for a in first if a != b and jaccard(sets[a], sets[b]) >= 0.8} and len(seen) == len(set(seen))


def test_blocks_hold_every_size_once():
    sizes = [(1, 5), (2, 900), (3, 40), (90, 1), (91, 30), (4000, 2)]
    bounds, place = B._deal(sizes, 6, 10)
    assert set(place) == {n for n, _ in sizes} and place[2][1] > 1
    assert all(bounds[first + k][0] <= n <= bounds[first + k][1] for n, (first, parts) in place.items() for k in range(parts))
    assert all(x[1] <= y[0] for x, y in zip(bounds, bounds[1:], strict=False)) and B._deal([], 6, 10) == ([], {})


def test_blocks_of_tables(spark, monkeypatch):
    monkeypatch.setattr(B, "SETS", 6)
    sets = families(11, 50)
    df = spark.createDataFrame(list(enumerate(sets)), "id long, codes array<long>").repartition(3)
    want = {(a, b): round(jaccard(sets[a], sets[b]), 6) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jaccard(sets[a], sets[b]) >= 0.8}
    got = B.block_pairs(df, 0.8).collect()
    assert len(got) == len(want) > 40 and {(r["a"], r["b"]): r["jaccard"] for r in got} == want
    met = B.block_met(df.filter("id < 40"), df.filter("id >= 40"), 0.8).collect()
    assert {r["id"] for r in met} == {b for a, b in want if a < 40 <= b} and len(met) == len({r["id"] for r in met}) > 0
    assert B.block_met(df.limit(0), df, 0.8).count() == B.block_met(df, df.limit(0), 0.8).count() == 0


def texts_like(seed, n):
    rng = np.random.default_rng(seed)
    syllables = np.array([a + b for a in "bdgkmnprst" for b in "aeiou"])
    out = []
    for i in range(n):
        words = rng.choice(syllables, int(rng.integers(20, 120)))
        out += ["".join(words), " ".join(words)] if i % 5 == 0 else ["".join(words)]
        if i % 3 == 0:
            words[rng.integers(len(words))] = "zz"
            out.append("".join(words))
    return out


@pytest.mark.parametrize("name", ["near_dup_greedy", "near_dup_pairs"])
def test_sets_are_shuffled_not_elements(spark, monkeypatch, name):
    """No row for each element of a set's prefix, and no pair that takes both its sets along."""
    seen, pairs = [], D.similar_pairs
    monkeypatch.setattr(D, "similar_pairs", lambda *a, **k: (seen.append(pairs(*a, **k)), seen[-1])[1])
    QUERIES[name](spark, "/root/testdata/sf0.001")
    (plan,) = (df._jdf.queryExecution().toString() for df in seen)
    assert "posexplode" not in plan and "Join Inner" not in plan and plan.count("MapInArrow") >= 2


@pytest.mark.parametrize("early", [20_000, 10])
def test_near_greedy_is_the_sequential_pass(spark, monkeypatch, early):
    monkeypatch.setattr(D, "EARLY", early)
    texts = texts_like(2, 70)
    texts = ["", "ab", None, *texts, texts[3], texts[0] + "!"]
    grams = [{f[i : i + 3] for i in range(len(f) - 2)} for f in ((t or "").replace(" ", "").replace("!", "") for t in texts)]
    kept = []
    for i, g in enumerate(grams):
        if g and not any(jaccard(grams[k], g) >= 0.8 for k in kept):
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert sorted(r["id"] for r in D.near_greedy(df, "id", F.col("text")).collect()) == kept and len(kept) < len(texts) - 15
