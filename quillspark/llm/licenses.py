"""License scan by diagonal voting.

Words are runs of a-z, 0-9 and everything from U+0080 on, in texts with A-Z lower-cased. Templates are short
phrases, found where all their words stand, and longer notices, found where most of their words do.

  grams     every run of k words (2 of a phrase, 4 of a notice) becomes one number: the words' numbers in the
            templates' dictionary as digits of a rolling polynomial hash whose base is the dictionary's size, so
            that different runs never meet. A run with a word of no template equals no template's run and has
            no number
  join      the numbers of all documents meet the template positions (k, number -> template, place) in one
            join; the template side is broadcast up to MOST_GRAMS rows and shuffled beyond
  votes     a hit's diagonal is its place in the document less its place in the template; votes are summed by
            document, template and diagonal
  merge     diagonals of a notice at most SHIFT apart are one span: words were put in or left out between
  verify    a phrase needs all its runs on one diagonal. A span's distinct covered words have to be
            LEAST_COVER of the notice, in a span at most twice as long

One shuffle, by document; it carries one row a document and its hits. The words of one document are judged
together, as the document is one row of the input.

Null and empty texts have no words: zeros, nulls, '' and score 0. Repeated rows and rows without an id are
judged one by one. Extra columns, clashing names among them, are ignored. An empty table gives no row.
Overlapping places (of phrases that share words) all count.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, tidy
from .words import slices

PHRASE_K, NOTICE_K = 2, 4
SHIFT, LEAST_COVER = 8, 0.6
MOST_GRAMS = 200_000

# Phrases whose places count as base, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Further phrases that name a license or a reservation of rights.
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "spdx license identifier": "spdx",
}

# The wording of well-known notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
    "and this permission notice appear in all copies": "isc",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
    "of any kind either express or implied": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this is free and unencumbered software released into the public domain": "public-domain",
}

#: Upper case to lower, word bytes to themselves, all others to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Templates:
    """Phrases and notices as numbers; entries are (words, label, base)."""

    def __init__(self, base: dict[str, str], phrases: dict[str, str], notices: dict[str, str]):
        texts = [(t, label, True, PHRASE_K) for t, label in base.items()] + [(t, label, False, PHRASE_K) for t, label in phrases.items()]
        texts += [(t, label, False, NOTICE_K) for t, label in notices.items()]
        self.vocab: dict[int, dict[bytes, int]] = {PHRASE_K: {}, NOTICE_K: {}}
        entries = []
        for text, label, is_base, k in texts:
            words = text.encode().translate(TABLE).split()
            if len(words) < k:
                raise ValueError(f"a template needs at least {k} words: {text}")
            own = self.vocab[k]
            entries.append((np.array([own.setdefault(w, len(own) + 1) for w in words], np.int64), label, is_base, k))
        for k, own in self.vocab.items():
            if (len(own) + 1) ** k >= 1 << 63:
                raise ValueError("too many different words in the templates")
        self.grams, self.entries = [], []
        for tid, (ids, label, is_base, k) in enumerate(entries):
            at, code = self.numbers(ids, k)
            self.grams += [(k, c, tid, p) for p, c in zip(at.tolist(), code.tolist(), strict=True)]
            self.entries.append((tid, label, is_base, k, len(ids)))

    def numbers(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and rolling hashes of the runs of k words that all stand in the dictionary."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base, code, known = len(self.vocab[k]) + 1, np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            part = ids[j : j + n]
            code = code * base + part
            known &= part > 0
        at = np.flatnonzero(known)
        return at, code[at]


STANDARD = Templates(BASE, PHRASES, NOTICES)
GRAMS = "rid long, doc_id long, n_words long, k int, pos long, code long"


def word_grams(df: DataFrame, templates: Templates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document (k null) and one for each run of words that can stand in a template."""
    names = [x.split()[0] for x in GRAMS.split(", ")]

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts, owner, kinds, places, codes = [], [], [], [], []
            for i, raw in enumerate(texts):
                lists = list(map(_ids, slices((raw or b"").translate(TABLE)), repeat(templates)))
                counts.append(sum(len(x[PHRASE_K]) for x in lists))
                for k in templates.vocab:
                    ids = np.concatenate([x[k] for x in lists]) if len(lists) > 1 else lists[0][k]
                    if not ids.any():
                        continue
                    at, code = templates.numbers(ids, k)
                    owner.append(np.full(len(at), i))
                    kinds.append(np.full(len(at), k, np.int32))
                    places.append(at)
                    codes.append(code)
            joined = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            owner = joined(owner, pa.int64())
            none = lambda m, kind: pa.nulls(m, kind)
            rids = pa.array(np.arange(rid, rid + n))
            yield pa.RecordBatch.from_arrays([rids, batch.column(0), pa.array(counts, pa.int64()), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int64())], names=names)
            m = len(owner)
            if m:
                yield pa.RecordBatch.from_arrays([rids.take(owner), none(m, pa.int64()), none(m, pa.int64()), joined(kinds, pa.int32()), joined(places, pa.int64()), joined(codes, pa.int64())], names=names)
            rid += n

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), GRAMS)


def _ids(words: list[bytes], templates: Templates) -> dict[int, np.ndarray]:
    return {k: np.fromiter(map(own.get, words, repeat(0)), np.int64, len(words)) for k, own in templates.vocab.items()}


def spans(df: DataFrame, templates: Templates = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document (tid -1) and one for each verified span: rid, doc_id, n_words, tid, label, base, first
    and last (words, last excluded), cover (share of the template's words)."""
    spark = df.sparkSession
    places = spark.createDataFrame(templates.grams, "k int, code long, tid int, tpos long")
    if len(templates.grams) <= MOST_GRAMS:
        places = F.broadcast(places)
    about = F.broadcast(spark.createDataFrame(templates.entries, "tid int, label string, base boolean, k int, m int"))  # one row a template
    hits = word_grams(df, templates, id_col, text_col).join(places, ["k", "code"], "left").filter("k is null or tid is not null")
    hits = hits.select("rid", "doc_id", "n_words", F.coalesce("tid", F.lit(-1)).alias("tid"), F.coalesce(F.col("pos") - F.col("tpos"), F.lit(0)).alias("diagonal"), "tpos")
    hits = hits.repartition(shuffle_partitions(spark), "rid")  # what follows stays within a document
    votes = hits.groupBy("rid", "tid", "diagonal").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("tpos").alias("at"))  # a place of the template once
    votes = votes.join(about, "tid", "left")
    w = Window.partitionBy("rid", "tid").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.when(F.col("k") == NOTICE_K, SHIFT).otherwise(0), F.lit(True))
    merged = votes.withColumn("_apart", apart.cast("long")).withColumn("span", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.select("rid", "doc_id", "n_words", "tid", "label", "base", "k", "m", "span", "diagonal", F.explode_outer("at").alias("t"))
    found = merged.groupBy("rid", "tid", "span").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "n_words", "label", "base", "k", "m")],
        F.collect_set("t").alias("at"), F.min(F.col("diagonal") + F.col("t")).alias("first"), (F.max(F.col("diagonal") + F.col("t")) + F.max("k")).alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    found = found.withColumn("cover", F.when(F.col("tid") >= 0, covered / F.col("m")))
    whole = (F.col("k") == PHRASE_K) & (F.size("at") == F.col("m") - F.col("k") + 1)
    near = (F.col("k") == NOTICE_K) & (F.col("cover") >= LEAST_COVER) & (F.col("last") - F.col("first") <= 2 * F.col("m"))
    return found.filter((F.col("tid") < 0) | whole | near).select("rid", "doc_id", "n_words", "tid", "label", "base", "first", "last", "cover")


def scan(df: DataFrame, templates: Templates = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, the base places, labels of the base and of all spans, the best cover."""
    base = F.coalesce("base", F.lit(False))
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        spans(df, templates, id_col, text_col).groupBy("rid").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"), labels(base).alias("base_labels"), labels(F.lit(True)).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        ).drop("rid")
    )
