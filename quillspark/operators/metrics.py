"""Evaluation: classification reports, recall at k, gold evidence, class weights, metric means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import located
from .anchors import evidence_places


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def domain(df: DataFrame, labels) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in labels], ["label"])


def classification_report(df: DataFrame, labels, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """label, precision, recall, f1, support; 0 where undefined; every label has a row."""
    each = df.select(F.col(true).alias("t"), F.col(pred).alias("p"))
    cells = each.groupBy("t", "p").agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred")))).alias("s"), "n", (F.col("t") == F.col("p")).alias("hit"))
    agg = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.when((F.col("s.is_true") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.col("n") * F.col("s.is_true")).alias("support"), F.sum(F.col("n") * F.col("s.is_pred")).alias("predicted"),
    )
    r = domain(df, labels).join(agg, "label", "left").na.fill(0, ["tp", "support", "predicted"])
    p, q = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return r.select("label", F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(ratio(2 * p * q, p + q), 6).alias("f1"), "support")


def validation(df: DataFrame, labels, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """The classification report with accuracy and macro F1 of all rows beside each label."""
    right = df.agg(F.round(ratio(F.count_if(F.col(true) == F.col(pred)), F.count("*")), 6).alias("accuracy"))  # one row
    report = classification_report(df, labels, true, pred)
    macro = report.agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return report.join(F.broadcast(right), F.lit(True)).join(F.broadcast(macro), F.lit(True))


def slowest(df: DataFrame, by: str, ties: str, n: int = 3) -> DataFrame:
    """The n rows of the greatest values (a report: the limit is the feature)."""
    return df.orderBy(F.desc(by), ties).limit(n)


def chunk_statistics(chunks: DataFrame, by: str = "strategy", text_col: str = "text") -> DataFrame:
    n = F.length(text_col)
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.round(F.avg(n), 6).alias("mean_chars"), F.max(n).alias("max_chars"))


def confusion(df: DataFrame, labels, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """One row per true label, one column n_<label> per predicted label, zero-filled."""
    sums = [F.sum(F.when(F.col(pred) == x, F.col("n")).otherwise(0)).alias(f"n_{x}") for x in labels]
    rows = df.groupBy(true, pred).agg(F.count("*").alias("n")).groupBy(F.col(true).alias("label")).agg(*sums)
    return domain(df, labels).join(rows, "label", "left").na.fill(0)


def missed(df: DataFrame, label, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """support, hits, missed, recall and whether the gate is met (0 where the class is absent)."""
    r = df.filter(F.col(true) == label).agg(F.count("*").alias("support"), F.count_if(F.col(pred) == label).alias("hits"))
    recall = ratio(F.col("hits"), F.col("support"))
    return r.select("support", "hits", (F.col("support") - F.col("hits")).alias("missed"), F.round(recall, 6).alias("recall"), (recall >= C.active().recall_gate).alias("gate"))


def source_breakdown(df: DataFrame, label, true: str = "y_true", pred: str = "y_pred", source: str = "source") -> DataFrame:
    """Sources over all rows of a true class, hits and misses alike, with the number of hits."""
    return df.filter(F.col(true) == label).groupBy(source).agg(F.count("*").alias("n"), F.count_if(F.col(pred) == label).alias("hits"))


def level_report(df: DataFrame, high, default, by: str = "mode", true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Per mode: recall, false positives, accuracy, errors (null predictions) and mean latency."""
    p = F.coalesce(F.col(pred), F.lit(default))
    return df.groupBy(by).agg(
        F.round(ratio(F.count_if((F.col(true) == high) & (p == high)), F.count_if(F.col(true) == high)), 6).alias("recall"),
        F.count_if((F.col(true) != high) & (p == high)).alias("false_positives"), F.round(F.avg((F.col(true) == p).cast("double")), 6).alias("accuracy"),
        F.count_if(F.col(pred).isNull()).alias("errors"), F.round(F.avg("latency"), 6).alias("latency"),
    )


def gold_pairs(evidence: DataFrame, chunks: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Pairs of evidence (item_id, evidence) and chunks whose text holds it; on: columns both share.

    Without such columns evidence finds its chunks by anchors (anchors.evidence_places), which also gives start
    and slice of each place. Blank evidence is in no chunk."""
    if on:
        return chunks.join(evidence, on).filter(located(F.col("text"), F.col("evidence")))
    return evidence_places(evidence, chunks)


def holders(pairs: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold any evidence by their gold pairs. A chunk is a part of its document's text, so
    evidence is in chunks of these alone; no others need to be cut."""
    some = pairs.select(F.col(key).alias("_key")).distinct()
    return docs.join(some, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def recall_at(hits: DataFrame, questions: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Share of all questions with a gold hit among the first k: hits (query_id, rank, gold)."""
    best = hits.filter("gold").groupBy("query_id").agg(F.min("rank").alias("best"))
    rows = questions.select("query_id").distinct().join(best, "query_id", "left")
    return rows.agg(F.count("*").alias("questions"), *[F.round(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in ks])


def drift(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items (doc_id, chunk_index, evidence) whose chunk is gone or no longer holds the evidence."""
    j = items.join(chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"], "left")
    return j.filter(~F.coalesce(located(F.col("text"), F.col("evidence")), F.lit(False))).drop("text")


def lift(df: DataFrame, baseline: str, key: str = "strategy", value: str = "recall") -> DataFrame:
    """Relative lift over the baseline's value; null where that is 0."""
    base = df.filter(F.col(key) == baseline).agg(F.max(value).alias("base"))
    return df.join(F.broadcast(base), F.lit(True)).select(key, value, F.round(F.try_divide(F.col(value) - F.col("base"), F.col("base")), 6).alias("lift"))


def metric_means(df: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Mean without NaN of each metric, rounded to 4, against its target: rows (metric, value)."""
    t = df.sparkSession.createDataFrame(list(targets.items()), ["metric", "target"])
    m = df.groupBy("metric").agg(F.round(F.avg(F.when(~F.isnan("value"), F.col("value"))), 4).alias("mean"))
    return t.join(m, "metric", "left").select("metric", "mean", "target", F.coalesce(F.col("mean") >= F.col("target"), F.lit(False)).alias("met"))


def class_weights(df: DataFrame, labels, label: str = "label") -> DataFrame:
    """N / (K * max(n, 1)) for each label."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    rows = domain(df, labels).join(n, "label", "left").na.fill(0, ["n"]).join(F.broadcast(total), F.lit(True))
    return rows.select("label", "n", F.round(F.col("total") / (len(labels) * F.greatest(F.col("n"), F.lit(1))), 6).alias("weight"))


def distribution(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def metric_grid(rows: DataFrame, judge, metrics: tuple[str, ...]) -> DataFrame:
    """Each row with a score per metric (null where the judge has no input): row_id, metric, value.

    rows: row_id, question, answer, contexts, reference.
    """
    args = [F.col(c) for c in ("question", "answer", "contexts", "reference")]
    scores = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(judge.score(m, *args), 6).alias("value")) for m in metrics])
    return rows.select("row_id", F.explode(scores).alias("s")).select("row_id", "s.metric", "s.value")


def side_by_side(rows: DataFrame, key: str, mode: str, value: str, modes: tuple[str, ...]) -> DataFrame:
    """One row per key, one column per mode."""
    return rows.groupBy(key).agg(*[F.max(F.when(F.col(mode) == m, F.col(value))).alias(m) for m in modes])


def verdicts(rows: DataFrame) -> DataFrame:
    """Cases by category and verdict; an open verdict is blank."""
    return rows.groupBy("category", F.coalesce("verdict", F.lit("")).alias("verdict")).agg(F.count("*").alias("n"))
