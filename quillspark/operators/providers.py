"""Model and language services behind small interfaces, with deterministic offline defaults.

The defaults are substitutes, not the models of a deployment: a hashed lexical encoder, a word-overlap
reranker and judge, a lexicon classifier. A provider returns Columns, so it stays in the plan.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import let
from .chain import CLOUD, Hop, Unreachable


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+", -1), lambda w: w != "")


class LexicalEncoder:
    """Sparse word weights and, from them, a dense vector of word counts by bucket (a hash of the word, or
    what bucket makes of it)."""

    def __init__(self, dim: int = 64, bucket=F.crc32):
        self.dim, self.bucket = dim, bucket

    words = staticmethod(words)

    def buckets(self, w: Column) -> Column:
        """The bucket of each of the words."""
        return F.transform(w, lambda x: F.pmod(self.bucket(x), F.lit(self.dim)))

    def sparse(self, c: Column) -> Column:
        """array<struct<token, weight>> with weight 1 + ln(count)."""
        count = lambda w, t: F.size(F.filter(w, lambda x: x == t)).cast("double")
        return let(words(c), lambda w: F.transform(F.array_distinct(w), lambda t: F.struct(t.alias("token"), (1 + F.log(count(w, t))).alias("weight"))))

    def dense(self, c: Column) -> Column:
        """Counts by bucket; words and buckets are found in the plan, the counting goes by Arrow batches."""
        dim = self.dim

        @F.arrow_udf("array<double>")
        def counts(buckets: pa.Array) -> pa.Array:
            owner = np.repeat(np.arange(len(buckets)), np.diff(buckets.offsets.to_numpy()))
            cells = np.bincount(owner * dim + buckets.flatten().to_numpy(), minlength=len(buckets) * dim).astype(np.float64)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * dim), pa.array(cells), mask=buckets.is_null())

        return counts(self.buckets(words(c)))


class OverlapReranker:
    """Share of the query's distinct words that the text holds."""

    def score(self, query: Column, text: Column) -> Column:
        return self.share(F.array_distinct(words(query)), words(text))

    def share(self, q: Column, own: Column) -> Column:
        """The same of the query's distinct words and the text's words."""
        return F.when(F.size(q) > 0, F.size(F.array_intersect(q, own)) / F.size(q)).otherwise(F.lit(0.0))


class OverlapJudge:
    """Lexical stand-ins for judged metrics; null where an input is missing."""

    METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")

    def score(self, metric: str, question: Column, answer: Column, contexts: Column, reference: Column) -> Column:
        overlap, joined = OverlapReranker().score, F.array_join(contexts, " ")
        pairs = {
            "faithfulness": (answer, joined), "answer_relevancy": (question, answer), "context_precision": (joined, reference),
            "context_recall": (reference, joined), "answer_correctness": (reference, answer),
        }
        return overlap(*pairs[metric])


class LexiconClassifier:
    """Class probabilities from counts of lexicon hits; null for null texts (no model)."""

    def __init__(self, high=C.HIGH_RISK, mid=C.MID_RISK, weak=C.WEAK_SIGNALS):
        self.parts = (high, mid, weak)

    def probabilities(self, c: Column) -> Column:
        """array of 4 in the order of LEVELS."""
        counts = F.array(*[F.regexp_count(c, F.lit("|".join(f"(?:{p})" for p in part))).cast("double") for part in self.parts])

        def shares(n: Column) -> Column:
            raw = [F.lit(1.0), F.get(n, 2), 2 * F.get(n, 1), 4 * F.get(n, 0)]
            total = raw[0] + raw[1] + raw[2] + raw[3]
            return F.array(*[r / total for r in raw])

        return F.when(c.isNotNull(), let(counts, shares))  # counted once, not again for each share


def failing_hop(name: str, unreachable: int, no_json: int, bad: int, source: str = CLOUD) -> Hop:
    """A service that tells a text's length and fails by it: unreachable at multiples of the first number, without
    JSON mode at those of the second, without an answer at all at those of the third (0: never)."""

    def answer(prompt: str, json_mode: bool):
        n = len(prompt)
        if n % unreachable == 0:
            return Unreachable("no route")
        if json_mode:
            return ValueError("no json mode") if n % no_json == 0 else json.dumps({"n": n})
        return ValueError("bad answer") if bad and n % bad == 0 else f"n={n}"

    return Hop(name, lambda prompts, json_mode: [answer(p, json_mode) for p in prompts], source, json_mode=True)


def hop_name(names: list[str], answers: list[Column]) -> Column:
    return F.coalesce(*[F.when(a.isNotNull(), F.lit(n)) for n, a in zip(names, answers, strict=True)])


def train_classifier(samples: DataFrame, text_col: str = "text", label_col: str = "label", weights: bool = True, features: int = 1 << 14):
    """Hashed word counts into a class-weighted logistic regression (pyspark.ml): a substitute model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    rows = samples.select(F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("label")).filter("text is not null and label is not null")
    if weights:
        n = rows.groupBy("label").count()
        total = n.agg(F.sum("count").alias("total"), F.count("*").alias("k"))
        w = n.crossJoin(total).select("label", (F.col("total") / (F.col("k") * F.col("count"))).alias("w"))
        rows = rows.join(F.broadcast(w), "label")
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(weightCol="w", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)
