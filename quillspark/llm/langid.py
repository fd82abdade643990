"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter: slot i holds a mask of one bit a language, in planes of eight languages; bit l
is set if language l put an n-gram there. The masks of an n-gram's slots ANDed give all languages containing it. A text's n-grams are
looked up at once; each language's popcount is corrected for its filter's false positives,
(hits - N f) / (1 - f), and the largest decides. The score is its share of the hits of all languages;
covered, where asked for, is its share of the text's n-grams that hold a letter and no digit (keys and
numbers say nothing of a language), so a text of a language not learned has little of it.

fit() learns every language that labels a text with a letter. It reads a bounded sample: about max_docs
documents of each, drawn by a hash of id and text at a rate set from counts over all rows, and always the
one of the least hash. Texts of at most max_chars characters come first; where a language has fewer than
max_docs of them, longer ones fill up with their first max_chars characters. An n-gram enters a language's
filter if its rate there is at least keep_share of the sum of its rates over all languages.

Null texts and texts without a letter (numbers, marks, fractions and Roman numerals are none) get "und" and
score 0. Repeated rows count once in training and come as often as they are there. An empty training set predicts "und".
Ties go to the language first in alphabetical order. The number of languages has no bound: the model takes
1 MB for each eight, the sample max_docs texts for each.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

N = 3
SLOT_BITS = 20
BLOCK_CHARS = 300_000  # characters looked up at once
_LIKELY = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no digits
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in _LIKELY.finditer(text) for c in m.group())


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts (a space around each), and where texts end."""
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(points < 33, np.uint32(32), points).astype(np.uint64)
    return points, np.cumsum([len(t) for t in lowered])


def _slots(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two slots for each n-gram of the code points."""
    n = len(points) - N + 1
    with np.errstate(over="ignore"):
        h = points[:n] * _K[0]
        for k in range(1, N):
            h = (h ^ (h >> np.uint64(31))) * _K[k] + points[k : n + k] * _K[0]
        h ^= h >> np.uint64(29)
        h *= _K[1]
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return (h >> np.uint64(44)).astype(np.int64), ((h >> np.uint64(20)) & mask).astype(np.int64)


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 if a digit, else 0."""
    return np.array([1 if c.isalpha() else 2 * c.isdigit() for c in map(chr, range(0x110000))], np.uint8)


class LanguageFilter:
    def __init__(self, langs: list[str], mask: np.ndarray):
        self.langs, self.mask = langs, mask  # mask: one row of slots for each eight languages
        self.false = np.array([((mask[l >> 3] >> (l & 7) & 1).mean()) ** 2 for l in range(len(langs))])

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], keep_share: float = 0.4) -> LanguageFilter:
        names = sorted(set(langs))
        mask = np.zeros((-(-len(names) // 8), 1 << SLOT_BITS), np.uint8)
        parts = []
        for lang in names:
            own = [t for t, l in zip(texts, langs, strict=True) if l == lang and t]
            a, b = _slots(_points(own)[0]) if own else (np.zeros(0, np.int64),) * 2
            grams, count = np.unique(a << SLOT_BITS | b, return_counts=True)
            parts.append((grams, count / max(1, count.sum())))
        if parts:
            grams = np.unique(np.concatenate([g for g, _ in parts]))
            total = np.zeros(len(grams))
            for g, r in parts:
                total[np.searchsorted(grams, g)] += r
            for l, (g, r) in enumerate(parts):
                good = g[r >= keep_share * total[np.searchsorted(grams, g)]]
                for slot in (good >> SLOT_BITS, good & ((1 << SLOT_BITS) - 1)):
                    mask[l >> 3, slot] |= np.uint8(1 << (l & 7))
        return cls(names, mask)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None], cover: bool = False) -> tuple[list[str], list[float], list[float]]:
        """Language, its share of the hits and, with cover, its share of the n-grams that hold a letter and no digit."""
        lang, score, covered = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not at or not self.langs:
            return lang, score, covered
        first = 0
        while first < len(at):
            last, size = first, 0
            while last < len(at) and (last == first or size + len(texts[at[last]]) < BLOCK_CHARS):
                size += len(texts[at[last]])
                last += 1
            part, first = at[first:last], last
            points, ends = _points([texts[i] for i in part])
            a, b = _slots(points)
            begins = np.concatenate([[0], ends[:-1]])
            n = ends - begins - N + 1
            for i, hits in zip(part, self._popcounts(a, b, begins, ends - N + 1, n), strict=True):
                k = int(np.argmax(hits))
                if hits[k] > 0:
                    lang[i], score[i] = self.langs[k], float(min(1.0, hits[k] / max(hits.sum(), 1e-9)))
                else:
                    lang[i] = self.langs[k]
            if cover:
                kind = _kinds()[points.astype(np.int64)]
                worded = (kind[:-2] | kind[1:-1] | kind[2:]) == 1
                for i, x, y in zip(part, begins.tolist(), (ends - N + 1).tolist(), strict=True):
                    k = self.langs.index(lang[i])
                    at_k = np.flatnonzero(worded[x:y]) + x
                    hit = int(((self.mask[k >> 3][a[at_k]] & self.mask[k >> 3][b[at_k]]) >> (k & 7) & 1).sum())
                    covered[i] = max(0.0, float((hit - len(at_k) * self.false[k]) / (1 - self.false[k]))) / max(1, len(at_k))
        return lang, score, covered

    def _popcounts(self, a, b, begins, ends, n) -> np.ndarray:
        out = np.zeros((len(n), len(self.langs)))
        for l in range(len(self.langs)):
            if l & 7 == 0:
                both = self.mask[l >> 3][a] & self.mask[l >> 3][b]
            run = np.concatenate([[0], np.cumsum(both >> (l & 7) & 1, dtype=np.int64)])
            out[:, l] = run[ends] - run[begins]
        return np.maximum(0, (out - n[:, None] * self.false) / (1 - self.false))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 400, max_chars: int = 20_000) -> LanguageFilter:
    """Learn a filter from the non-null texts and labels of train; see the module for the bound."""
    rows = train.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.filter(F.col("t").rlike(r"\p{L}") & F.col("l").isNotNull())
    rows = rows.withColumn("long", F.length("t") > max_chars).withColumn("h", F.xxhash64("i", "t"))
    few, many = F.count(F.when(~F.col("long"), 1)).alias("few"), F.count(F.when(F.col("long"), 1)).alias("many")
    counts = rows.groupBy("l").agg(few, many, F.min(F.struct("long", "h")).alias("least")).collect()
    if not counts:
        return LanguageFilter([], np.zeros((0, 1 << SLOT_BITS), np.uint8))
    rates = [(r["l"], min(1.0, max_docs / max(1, r["few"])), min(1.0, max(0, max_docs - r["few"]) / max(1, r["many"])), *r["least"]) for r in counts]
    kinds = "l string, rate_short double, rate_long double, least_long boolean, least_h long"
    drawn = F.broadcast(train.sparkSession.createDataFrame(rates, kinds))
    unit = F.pmod("h", F.lit(1_000_000)) / 1_000_000
    least = (F.col("long") == F.col("least_long")) & (F.col("h") == F.col("least_h"))
    some = rows.join(drawn, "l").filter(least | (unit < F.when(F.col("long"), F.col("rate_long")).otherwise(F.col("rate_short"))))
    # equal rows count once, so copies of one document cannot fill the driver
    found = some.select("i", F.substring("t", 1, max_chars).alias("t"), "l", "h").dropDuplicates(["l", "h"]).collect()
    found.sort(key=lambda r: (r["i"] is not None, r["i"], r["l"], r["t"]))
    return LanguageFilter.fit([r["t"] for r in found], [r["l"] for r in found])


def identify(df: DataFrame, model: LanguageFilter, text_col: str = "text", cover: bool = False) -> DataFrame:
    """df with lang_pred string and score double, with cover also covered double; existing columns of
    these names, in any case, are replaced."""
    added = ["lang_pred", "score", *(["covered"] if cover else [])]
    rest = [c for c in df.columns if c.lower() not in added]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    held = df.sparkSession.sparkContext.broadcast(model)  # SLOT_BITS fixes its size: 1 MB
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "lang_pred string", "score double", *(["covered double"] if cover else [])])

    def run(batches):
        m = held.value
        for batch in batches:
            lang, *shares = m.judge(batch.column(batch.schema.names.index(text_col)).to_pylist(), cover)
            found = [pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in shares[: len(added) - 1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in rest), *found], names=[*rest, *added])

    return df.select(*rest).mapInArrow(tidy(run), out)
