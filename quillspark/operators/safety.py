"""Safety classification of conversation turns: ordered rules, escalation, fusion, semantic upgrade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import json_object, let, mask_pii, minimised_context

NORMAL, MILD, MID, HIGH = C.LEVELS


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def first_pattern(c: Column, patterns) -> Column:
    return F.coalesce(*[F.when(c.rlike(p), F.lit(p)) for p in patterns])


def masked(c: Column, patterns=C.NEGATED) -> Column:
    """Every match replaced by as many full-width stars, pattern after pattern."""
    def starred(p: str):
        def run(c: Column) -> Column:
            stars = F.transform(F.regexp_extract_all(c, F.lit(p), 0), lambda m: F.repeat(F.lit("＊"), F.length(m)))
            return F.array_join(F.zip_with(F.split(c, p, -1), stars, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

        return run

    for p in patterns:
        c = let(c, starred(p))  # each step reads the one before twice
    return c


def rule_level(c: Column, high=C.HIGH_RISK, mid=C.MID_RISK, negated=C.NEGATED) -> Column:
    """struct<level, rule> of one text; high patterns see the text with negations masked."""
    found = F.struct(let(masked(c, negated), lambda x: first_pattern(x, high)).alias("h"), first_pattern(c, mid).alias("m"))
    level = lambda f: F.when(f["h"].isNotNull(), F.lit(HIGH)).when(f["m"].isNotNull(), F.lit(MID)).otherwise(F.lit(NORMAL))
    return let(found, lambda f: F.struct(level(f).alias("level"), F.coalesce(f["h"], f["m"]).alias("rule")))


@C.configured
def escalated(turns: DataFrame, weak=C.WEAK_SIGNALS, rounds: int = C.setting("escalation_rounds")) -> DataFrame:
    """User turns with escalated: the user's last `rounds` turns before all hold a weak signal."""
    users = turns.filter("role = 'user'")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-rounds, -1)
    weak_here = F.when(F.col("text").rlike(any_of(weak)), 1).otherwise(0)
    return users.withColumn("escalated", F.coalesce(F.sum(weak_here).over(w), F.lit(0)) == rounds)


def rule_levels(turns: DataFrame, high=C.HIGH_RISK, mid=C.MID_RISK, negated=C.NEGATED, weak=C.WEAK_SIGNALS) -> DataFrame:
    """conv_id, turn, level and rule of every user turn, escalation included."""
    r = escalated(turns, weak).withColumn("r", rule_level(F.col("text"), high, mid, negated))
    up = (F.col("r.level") == NORMAL) & F.col("escalated")
    return r.select("conv_id", "turn", F.when(up, F.lit(MID)).otherwise(F.col("r.level")).alias("level"), F.when(up, F.lit("escalation")).otherwise(F.col("r.rule")).alias("rule"))


@C.configured
def fused(rule: Column, probs: Column, threshold: float = C.setting("model_threshold")) -> Column:
    """struct<level, source, confidence> from the rule level and the model's probabilities (or null)."""
    return let(F.struct(rule.alias("rule"), probs.alias("probs")), lambda x: _fused(x["rule"], x["probs"], threshold))


def _fused(rule: Column, probs: Column, threshold: float) -> Column:
    best = F.array_max(probs)
    argmax = F.element_at(F.array(*map(F.lit, C.LEVELS)), F.array_position(probs, best).cast("int"))
    p_high = F.element_at(probs, 4)
    cases = [
        (rule == HIGH, HIGH, 0, F.lit(1.0)),
        (probs.isNull() | (best <= threshold), rule, 0, F.lit(0.6)),
        ((rule == MID) & (p_high > threshold), HIGH, 2, p_high),
        (F.lit(True), argmax, 1, best),
    ]
    out = None
    for when, level, source, confidence in reversed(cases):
        row = F.struct((F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(C.SOURCES[source]).alias("source"), confidence.cast("double").alias("confidence"))
        out = row if out is None else F.when(when, row).otherwise(out)
    return out


def upgraded(base: Column, level: Column, referent: Column) -> Column:
    """Only a high level about the speaker lifts the result; invalid verdicts leave it alone."""
    ok = level.isin(*C.LEVELS) & referent.isin(*C.REFERENTS)
    lift = ok & (level == HIGH) & (referent == C.REFERENTS[0])
    return F.when(
        F.coalesce(lift, F.lit(False)), F.struct(F.lit(HIGH).alias("level"), F.lit(C.SOURCES[3]).alias("source"), F.lit(0.9).alias("confidence"), referent.alias("referent"))
    ).otherwise(F.struct(base["level"].alias("level"), base["source"].alias("source"), base["confidence"].alias("confidence"), F.when(ok, referent).alias("referent")))


def judged(base: Column, answer: Column) -> Column:
    """The base result lifted by a semantic judge's answer, a JSON object with level and referent. An
    unreadable answer, or none, leaves the base as it is: the judge only ever adds."""
    v = json_object(answer)
    return upgraded(base, *[F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ("level", "referent")])


def referent_of(answer: Column) -> Column:
    """The referent of a referent-only judge's answer, known values only; unreadable: none."""
    return known_or(F.try_variant_get(json_object(answer), "$.referent", "string"), C.REFERENTS)


def ordinal(level: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, C.LEVELS)), level) - 1).cast("int")


@C.configured
def resampled(samples: Column, extra: int = C.setting("resamples")) -> Column:
    """Level of the first sample unless it is the middle one; then the highest of it and the next ones."""
    first = F.get(samples, 0)
    more = F.filter(F.slice(samples, 1, extra + 1), lambda s: s.isin(*C.LEVELS))
    top = F.aggregate(more, first, lambda a, s: F.when(ordinal(s) > ordinal(a), s).otherwise(a))
    return F.when(first == MID, top).otherwise(first)


def known_or(c: Column, allowed, default: Column | None = None) -> Column:
    """Fail-closed: null for unknown values; fail-open: the default."""
    ok = F.when(c.isin(*allowed), c)
    return ok if default is None else F.coalesce(ok, default)


@C.configured
def alert_records(turns: DataFrame, level: str = "level", limit: int = C.setting("summary_chars")) -> DataFrame:
    """Alerts of high turns: masked summary and the last messages before, masked.

    turns: conv_id, turn, role, text, level (null but on user turns).
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-C.active().context_messages, -1)
    before = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w)
    high = turns.withColumn("before", before).filter(F.col(level) == HIGH)
    return high.select(
        F.xxhash64("conv_id", "turn").alias("alert_id"), "conv_id", "turn", F.col(level).alias("emotion_level"),
        F.left(mask_pii(F.col("text")), F.lit(limit)).alias("trigger_summary"), minimised_context(F.col("before")).alias("recent_context"),
    )


def annotated(alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """Alerts with the latest note's referent: notes (alert_id, referent, seq)."""
    last = notes.groupBy("alert_id").agg(F.max_by("referent", "seq").alias("referent"))
    return alerts.join(last, "alert_id", "left")
