"""The chain of services against one call a row; swapped tables; counts of the writing pass."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chain as C
from quillspark.sources import corpus, sinks


def by_rule(rule):
    return lambda prompts, json_mode: [rule(p, json_mode) for p in prompts]


def test_hops(spark):
    seen = []

    def light(p, json_mode):
        seen.append((p, json_mode))
        if "down" in p:
            return C.Unreachable("no route")
        return ValueError("no json") if json_mode and "plain" in p else ValueError("bad") if "bad" in p else f"light {json_mode}"

    hops = [C.Hop("light", by_rule(light), json_mode=True), C.Hop("core", by_rule(lambda p, j: ValueError("busy") if "busy" in p else "core"), off=None), C.Hop("local", by_rule(lambda p, j: "local"), C.LOCAL, off="switched off")]
    got = C.answers(["a", "plain", "down", "bad", "down busy", None, "bad busy"], hops)
    assert got == [
        ("light True", "light", C.CLOUD, None), ("light False", "light", C.CLOUD, None), ("core", "core", C.CLOUD, "light: no route"), ("core", "core", C.CLOUD, "light: bad"),
        (None, None, None, "light: no route；core: busy；local: switched off"), (None, None, None, None), (None, None, None, "light: bad；core: busy；local: switched off"),
    ]
    assert ("down", False) not in seen and ("a", False) not in seen and ("bad", False) in seen  # unreachable hops are not tried again
    df = spark.createDataFrame([(1, "plain", "x"), (2, "down busy", "y"), (3, None, "z")], "id int, text string, Answer string")
    rows = C.answered(df, F.col("text"), [C.Hop("light", lambda p, j: [str(len(x)) for x in p])]).orderBy("id").collect()
    assert [(r["id"], r["text"], r["answer"], r["source"]) for r in rows] == [(1, "plain", "5", C.CLOUD), (2, "down busy", "9", C.CLOUD), (3, None, None, None)]
    assert C.answered(df.limit(0), F.col("text"), hops).count() == 0


def test_a_whole_call_that_fails():
    def broken(prompts, json_mode):
        raise C.Unreachable("timeout")

    hops = [C.Hop("light", broken, json_mode=True), C.Hop("core", lambda p, j: ["one"]), C.Hop("local", lambda p, j: [x.upper() for x in p], C.LOCAL)]
    assert C.answers(["a", "b"], hops) == [("A", "local", C.LOCAL, "light: timeout；core: 1 answers to 2 prompts"), ("B", "local", C.LOCAL, "light: timeout；core: 1 answers to 2 prompts")]


def test_swap_keeps_the_old_table_if_the_new_one_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    sinks.swap_in(spark.range(3), path)
    sinks.swap_in(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises
        sinks.swap_in(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["cache"]  # nothing is left beside it


def test_parse_and_build_count_in_the_writing_pass(spark, tmp_path):
    root = tmp_path / "in" / "通知"
    root.mkdir(parents=True)
    for i in range(7):
        (root / f"n{i}.txt").write_text(f"text {i}")
    (root / "broken.pdf").write_bytes(b"%PDF")
    records, failures, facts = corpus.parsed_once(corpus.scan_files(spark, f"{tmp_path}/in"))
    assert (records.count(), failures.count()) == (7, 1)
    assert facts["files"] == 8 and facts["failed"] == 1 and facts["bytes"] == 46 and facts["elapsed_s"] > 0
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    chunks = records.select(F.col("name").alias("source_file"), "text").mapInArrow(counted, "source_file string, text string")
    faq = spark.createDataFrame([(1, "q")], "entry_id int, question string")
    got = sinks.build_index(chunks, faq, failures, f"file://{tmp_path}/index")
    assert {k: got[k] for k in ("chunk_count", "faq_rows", "failed_files")} == {"chunk_count": 7, "faq_rows": 1, "failed_files": 1}
    assert reads.value == 7  # made once
    assert spark.read.parquet(f"file://{tmp_path}/index/chunks").count() == 7
