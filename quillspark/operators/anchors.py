"""Where evidence stands in texts: winnowed anchors meet in a join, then places are verified.

White space is left out on both sides. Evidence of one class of lengths takes runs of k characters; from each
w runs in a row those with the smallest hash are kept, on both sides by the same rule, so all runs kept of an
evidence are kept in every text that holds it. Its anchor is the one that the texts hold most rarely. Texts
meet evidence by anchors alone; the candidate's place is then compared character by character and given back
as the verbatim slice. Nothing is collected, and the texts are read once for their runs and once to verify.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import scratch

#: (characters of a run, runs in a row) of evidence with at least k + w - 1 characters; shorter evidence is a run itself.
CLASSES = ((16, 17), (4, 5))
BASE = 0x9E3779B97F4A7C15
# The Unicode white space characters.
BLANK = np.array([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
INKED = ~np.isin(np.arange(0x3002), BLANK)  # by character; the last stands for all beyond
CHARS = 250_000  # of texts that are hashed together


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def bare(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters that are no white space, and their places."""
    chars = characters(text)
    at = np.flatnonzero(INKED[np.minimum(chars, len(INKED) - 1)])
    return chars[at], at


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(chars: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k characters, by doubling."""
    part, size, done, length = _mixed(chars.astype(np.uint64) + np.uint64(1)), 1, None, 0
    while True:
        if k & size:
            done = part if done is None else done[: len(part) - length] * np.uint64(pow(BASE, size, 1 << 64)) + part[length:] if len(part) > length else part[:0]
            length += size
        if size * 2 > k:
            return _mixed(done[: max(0, len(chars) - k + 1)])
        part = part[: max(0, len(part) - size)] * np.uint64(pow(BASE, size, 1 << 64)) + part[size:]
        size *= 2


def _slid(x: np.ndarray, w: int, best) -> np.ndarray:
    """The best of every w entries in a row, by doubling."""
    size = 1
    while size * 2 <= w:
        x, size = best(x[:-size], x[size:]), size * 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def kept_runs(chars: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that are smallest among some w in a row of one text: its number, place and hash. The texts stand one
    after another in chars, up to their ends."""
    h = _runs(chars, k)
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h[:0]
    size = np.diff(ends, prepend=0)
    low = _slid(h, w, np.minimum)
    inside = np.repeat(ends, size)[: len(low)] - np.arange(len(low)) >= k + w - 1  # the others reach into the next text
    low = np.where(inside, low, np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slid(np.concatenate([edge, low, edge]), w, np.maximum) == h)
    text = np.searchsorted(ends, at, "right")
    return text, at - (ends - size)[text], h[at]


def class_of(length: int) -> tuple[int, int]:
    return next(((k, w) for k, w in CLASSES if length >= k + w - 1), (length, 1))


RUNS = "owner long, k int, w int, hash long, at long"


def _runs_of(df: DataFrame, classes: list[tuple[int, int]] | None) -> DataFrame:
    """The kept runs of (owner, text): of the classes, or each text's of its own class. Texts are hashed together,
    some at a time, as most of them are short."""

    def run(batches):
        for batch in batches:
            owner, texts = batch.column(0).to_numpy(), [x or "" for x in batch.column(1).to_pylist()]
            stop, lo = np.cumsum([0, *map(len, texts)]), 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(stop, stop[lo] + CHARS, "right")) - 1)
                chars, at = bare("".join(texts[lo:hi]))
                ends = np.searchsorted(at, stop[lo + 1 : hi + 1] - stop[lo])
                own = None if classes is not None else [class_of(n) if n else None for n in np.diff(ends, prepend=0).tolist()]
                for k, w in classes if own is None else {*own} - {None}:
                    text, place, h = kept_runs(chars, ends, k, w)
                    if own is not None:
                        good = np.array([x == (k, w) for x in own])[text]
                        text, place, h = text[good], place[good], h[good]
                    same = [pa.array(np.full(len(h), x, np.int32)) for x in (k, w)]
                    yield pa.RecordBatch.from_arrays([pa.array(owner[lo:hi][text]), *same, pa.array(h.view(np.int64)), pa.array(place)], names=["owner", "k", "w", "hash", "at"])
                lo = hi

    return df.select("owner", "text").mapInArrow(run, RUNS)


def evidence_places(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs of evidence (item_id, evidence) and texts (text and any other columns) that hold it: the columns
    of texts and item_id, start (character) and slice of its first place. Blank evidence is in no text."""
    rest = [c for c in texts.columns if c not in ("item_id", "text")]
    pool = scratch(texts.select(F.monotonically_increasing_id().alias("owner"), "text", F.struct(F.lit(0).alias("_"), *rest).alias("row")).filter("text is not null"))
    asked = scratch(evidence.select(F.monotonically_increasing_id().alias("owner"), F.col("item_id").cast("long").alias("item_id"), F.col("evidence").alias("text")).filter("text is not null"))
    own = scratch(_runs_of(asked, None))
    # the classes that occur: two, and one for each length below the smaller one's
    classes = [(r["k"], r["w"]) for r in own.select("k", "w").distinct().collect()]
    if not classes:
        return texts.select(*rest).limit(0).selectExpr("*", "cast(null as long) as item_id", "cast(null as int) as start", "cast(null as string) as slice")
    key = ["k", "w", "hash"]
    hits = scratch(_runs_of(pool, classes).join(own.select(*key).distinct(), key, "left_semi"))
    often = hits.groupBy(*key).agg(F.count("*").alias("n"))
    rarest = own.join(often, key, "left").groupBy("owner").agg(F.min_by(F.struct(*key, "at", F.col("n").isNotNull().alias("held")), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("m"))
    anchors = rarest.filter("m.held").select(F.col("owner").alias("item"), "m.k", "m.w", "m.hash", F.col("m.at").alias("back"))
    # written, as its size tells the plan whether the texts have to be shuffled to meet it
    meet = scratch(hits.join(anchors, key).select("owner", "item", (F.col("at") - F.col("back")).alias("place")).filter("place >= 0"))
    places = pool.join(meet, "owner").join(asked.select(F.col("owner").alias("item"), "item_id", F.col("text").alias("evidence")), "item")

    def verified(batches):
        for batch in batches:
            keep, starts, slices, known, chars, at = [], [], [], None, None, None
            for i, (owner, place, needle, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if owner != known:
                    known, (chars, at) = owner, bare(text)
                want, _ = bare(needle)
                if np.array_equal(chars[place : place + len(want)], want):
                    keep.append(i)
                    starts.append(int(at[place]))
                    slices.append(text[starts[-1] : int(at[place + len(want) - 1]) + 1])
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), part.column(5), part.column(6), pa.array(starts, pa.int32()), pa.array(slices, pa.string())], names=["owner", "item", "item_id", "row", "start", "slice"])

    kind = pool.schema["row"].dataType.simpleString()
    found = places.select("owner", "place", "evidence", "text", "item", "item_id", "row").mapInArrow(verified, f"owner long, item long, item_id long, row {kind}, start int, slice string")
    first = found.groupBy("owner", "item").agg(F.min(F.struct("start", "slice")).alias("m"), F.first("row").alias("row"), F.first("item_id").alias("item_id"))
    return first.select(*[F.col(f"row.{c}").alias(c) for c in rest], "item_id", "m.start", "m.slice")
