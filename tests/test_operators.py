"""Chunking, retrieval, safety, routing, metrics, dedup, sources and sinks on small rows."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import config as C
from quillspark.functions import html as H
from quillspark.operators import chunking as K
from quillspark.operators import dedup as D
from quillspark.operators import metrics as M
from quillspark.operators import providers as P
from quillspark.operators import routing as R
from quillspark.operators import safety as S
from quillspark.operators import vector as V
from quillspark.sources import corpus, sinks


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")


def pieces(df):
    return [r["text"] for r in df.orderBy("id", "chunk_index").collect()]


def test_marked_chunks(spark):
    assert pieces(K.by_marker(texts(spark, "前言\n问：一？\n答：甲\n问：二？\n答：乙"))) == ["问：一？\n答：甲", "问：二？\n答：乙"]
    assert pieces(K.by_marker(texts(spark, "  无标记 ", ""))) == ["无标记", ""]


def test_titled_chunks(spark):
    t = "开头\n关于选课工作的通知\n内容一\n关于放假安排的公告\n内容二"
    assert pieces(K.by_title(texts(spark, t))) == ["关于选课工作的通知\n内容一", "关于放假安排的公告\n内容二"]
    assert pieces(K.by_title(texts(spark, "单条"))) == ["单条"]


def test_fixed_chunks_cover_the_text(spark):
    t = "".join(chr(97 + i % 26) for i in range(2000))
    got = pieces(K.fixed(texts(spark, t, "")))
    assert got[0] == t[:768] and got[1] == t[692:1460] and got[-1] == t[1384:]


def test_recursive_chunks(spark):
    t = "\n\n".join("段落" + "字" * 100 for _ in range(20))
    got = pieces(K.recursive(texts(spark, t, "", "x" * 1000)))
    assert len(got) > 3 and all(len(p) <= 844 for p in got) and got[-2:] == ["x" * 768, "x" * 308]


def test_recursive_chunks_step_by_step(spark):
    cases = {
        "aaaa bbbb cccc": ["aaaa bbbb ", "bb cccc"],  # words strung together; the last three characters begin the next chunk
        "one two three.\n\nfour": ["one two ", "wo wo wo three.\n", "e.\nfour"],  # every level of splitting overlaps anew
        "abcdefghijklmnopq": ["abcdefghij", "hijklmnopq", "opq"],  # nothing to split at: windows
        " \n \n": [], "ab": ["ab"], "一二。三四五六七八九十甲。乙": ["一二。", "一二。三四五六七八九十甲。", "十甲。乙"],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id long, text string")
    got: dict = {}
    for r in K.recursive(df, size=10, overlap=3).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert {t: got.get(i, []) for i, t in enumerate(cases)} == cases
    plain = K.recursive(df, size=10, overlap=0).groupBy("id").agg(F.concat_ws("", F.sort_array(F.collect_list(F.struct("chunk_index", "text")))["text"]).alias("t")).collect()
    assert all("".join(r["t"].split()) == "".join(list(cases)[r["id"]].split()) for r in plain)  # without overlaps nothing is lost or doubled


def test_types_and_tables(spark):
    df = spark.createDataFrame([(1, "FAQ", "Q: a\nb"), (2, "表格", "1|2"), (3, "?", "abc")], "id int, doc_type string, text string")
    got = {(r["id"], r["doc_type"]): r["text"] for r in K.by_type(df).collect()}
    assert got == {(1, "FAQ"): "Q: a\nb", (2, "表格"): "这是的表格内容\n1|2", (3, "手册"): "abc"}


def test_qa_pairs(spark):
    t = "1、问：如何办理借书证？ 答：请携带校园卡到总馆一楼前台办理。\n2. 是否开放？答：短\n"
    got = K.qa_pairs(texts(spark, t)).collect()
    assert [(r["question"], r["answer"]) for r in got] == [("如何办理借书证？", "请携带校园卡到总馆一楼前台办理。")]


def test_page_parts(spark):
    page = (
        '<html><head><title> T </title></head><body><div class="nav">x</div><div class="article">short</div>'
        '<div class="content">long <b>bo</b>dy<p>second</p></div><ul class="news">'
        + "".join(f'<li><a href="/a{i}/page.htm">培养 | t{i}</a></li>' for i in (1, 2, 3, 3)) + '</ul><a href="/x/list9.htm">尾页</a><a href="f.PDF">f</a></body></html>'
    )
    df = spark.createDataFrame([(1, "http://h/", page), (2, "http://h/2", None)], "page_id long, url string, html string")
    body = {r["page_id"]: r["b"] for r in df.select("page_id", H.body_text_udf("html").alias("b")).collect()}
    assert body == {1: "long body\nsecond", 2: ""}
    items = H.list_items(df).orderBy("pos").collect()
    assert [(r["title"], r["href"]) for r in items] == [(f"t{i}", f"http://h/a{i}/page.htm") for i in (1, 2, 3)]
    r = df.filter("page_id = 1").select(H.page_title(F.col("html"), F.col("url")).alias("t"), H.total_pages(F.col("html")).alias("n")).first()
    assert (r["t"], r["n"]) == ("T", 9)
    assert [x["href"] for x in H.links(df, only=C.SUFFIX_RE).collect()] == ["f.PDF"]
    assert H.decode_page("<meta charset=gbk>中".encode("gbk")).endswith("中")


def test_rules(spark):
    level = lambda t: texts(spark, t).select(S.rule_level(F.col("text")).alias("r")).first()["r"]["level"]
    assert level("我不想活了") == "高危" and level("我真的想去死") == "高危"
    assert level("我不会去死的") == "正常" and level("从没想过自杀") == "正常"
    assert level("我是个废物") == "中度困扰" and level("今天天气好") == "正常"


def test_escalation(spark):
    rows = [(1, i, "user", t) for i, t in enumerate(["好难", "好累", "压力好大", "嗯", "嗯"])] + [(2, 0, "user", "好难")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["level"] for r in S.rule_levels(df).collect()}
    assert got[1, 3] == "中度困扰" and got[1, 4] == "正常" and got[1, 2] == "正常"


@pytest.mark.parametrize(
    ("rule", "probs", "want"),
    [
        ("高危", None, ("高危", "规则引擎", 1.0)), ("中度困扰", None, ("中度困扰", "规则引擎", 0.6)), ("正常", [0.4, 0.3, 0.2, 0.1], ("正常", "规则引擎", 0.6)),
        ("中度困扰", [0.1, 0.1, 0.2, 0.6], ("高危", "规则+模型融合", 0.6)), ("中度困扰", [0.7, 0.1, 0.1, 0.1], ("正常", "分类模型", 0.7)), ("正常", [0.1, 0.1, 0.1, 0.7], ("高危", "分类模型", 0.7)),
    ],
)
def test_fusion(spark, rule, probs, want):
    df = spark.createDataFrame([(rule, probs)], "r string, p array<double>")
    assert tuple(df.select(S.fused(F.col("r"), F.col("p")).alias("e")).first()["e"]) == want


def test_resampling_and_alerts(spark):
    df = spark.createDataFrame([(["中度困扰", "高危", "正常"],), (["轻度困扰", "高危", "高危"],), (["中度困扰", "?", "轻度困扰"],)], "s array<string>")
    assert [r["x"] for r in df.select(S.resampled(F.col("s")).alias("x")).collect()] == ["高危", "轻度困扰", "中度困扰"]
    turns = spark.createDataFrame([(1, i, "user", f"m{i} 13812345678" + "字" * 200, "高危" if i == 4 else None) for i in range(5)], "conv_id long, turn long, role string, text string, level string")
    a = S.alert_records(turns).first()
    assert len(a["recent_context"]) == 3 and len(a["trigger_summary"]) == 100 and "138" not in a["trigger_summary"] + a["recent_context"][0]["content"]


def test_language_history_quality(spark):
    rows = [("s", 0, None, None, None), ("s", 1, None, "English", None), ("s", 2, None, "Latin", None), ("s", 3, "高危", "中文", None), ("u", 0, None, None, "English")]
    df = spark.createDataFrame(rows, "session string, turn int, level string, requested string, input_language string")
    got = [r["language"] for r in R.session_language(df).orderBy("session", "turn").collect()]
    assert got == ["中文", "English", "English", "English", "English"]
    h = spark.createDataFrame([([("user", str(i)) for i in range(25)],), ([],)], "h array<struct<role:string,content:string>>")
    assert [r["n"] for r in h.select(F.size(R.history_after(F.col("h"), F.lit("q"), F.lit("a"))).alias("n")).collect()] == [20, 2]
    v = spark.createDataFrame([([(False, 0.1), (True, 0.9)],), ([(False, 0.1), (False, 0.2)],), ([],)], "v array<struct<passed:boolean,score:double>>")
    assert [tuple(r["q"]) for r in v.select(R.quality(F.col("v")).alias("q")).collect()] == [(2, 0.9, False), (2, 0.5, True), (1, 0.5, False)]


def test_answer_routes(spark):
    rows = [(1, 0, "user", "我不想活了"), (1, 1, "user", "??"), (2, 0, "user", "图书馆在哪里"), (3, 0, "user", "where is the library"), (3, 1, "assistant", "on campus"), (3, 2, "user", "opening hours of the library today")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chunks = spark.createDataFrame([(1, "the library opens at eight and its opening hours of today end at ten", "全部", "长期有效"), (2, "opening hours of the library today: closed", "研究生", "长期有效")], "id long, text string, audience string, valid string")
    faq = spark.createDataFrame([(7, "Where is the library?", "At the gate.", ["library where"], None)], "entry_id long, question string, answer string, similar_questions array<string>, tags array<string>")
    memories = spark.createDataFrame([(3, "asked about books", 1), (3, "asked about rooms", 2)], "conv_id long, summary string, at long")
    got = {(r["conv_id"], r["turn"]): r for r in R.answer(turns, chunks, faq, memories).collect()}
    assert {k: (r["level"], r["response_source"]) for k, r in got.items()} == {(1, 0): ("高危", "crisis"), (1, 1): ("正常", "chitchat"), (2, 0): ("正常", "fallback"), (3, 0): ("正常", "faq"), (3, 2): ("正常", "generated")}
    assert got[1, 0]["route"] == "report>care_response" and got[1, 1]["route"] == "chitchat_response>care_suffix>end"
    crisis = got[1, 0]["response"]
    assert "120" in crisis and "110" in crisis and C.DEFAULT.care_info in crisis and "身边正有人" in crisis and got[1, 0]["summary"] is None
    assert got[3, 0]["response"] == "At the gate." and got[3, 0]["match_id"] == 7 and got[3, 0]["route"] == "retrieve>care_suffix>memory_write"
    assert got[2, 0]["language"] == "中文" and got[2, 0]["forced"] and got[2, 0]["route"].count("generate>quality_check") == 3 and "无法生成" in got[2, 0]["response"]
    assert got[3, 2]["contexts"] == [1] and got[3, 2]["retry_count"] == 1 and "on campus" in got[3, 2]["prompt"] and "rooms" in got[3, 2]["prompt"]
    assert R.answer(turns).filter("response_source = 'generated'").count() == 0


def test_settings_of_the_session(spark):
    spark.conf.set("spark.quillspark.chunk_size", "10")
    spark.conf.set("spark.quillspark.chunk_overlap", "0")
    try:
        assert pieces(K.fixed(texts(spark, "x" * 25))) == ["x" * 10, "x" * 10, "x" * 5]
        assert pieces(K.fixed(texts(spark, "x" * 25), size=20)) == ["x" * 20, "x" * 5]
    finally:
        spark.conf.unset("spark.quillspark.chunk_size")
        spark.conf.unset("spark.quillspark.chunk_overlap")
    assert pieces(K.fixed(texts(spark, "x" * 25))) == ["x" * 25]


def test_sessions_longer_than_a_batch(spark, tmp_path):
    from quillspark.streaming.sessions import run_once, session_states

    rng = np.random.default_rng(4)
    data = [(c, k, "user" if rng.random() < 0.7 else "assistant", str(rng.choice(["好难", "ok"], p=[0.7, 0.3]))) for c in range(3) for k in range(400)]
    order = rng.permutation(len(data)).tolist()
    spark.createDataFrame([data[i] for i in order], "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"file://{tmp_path}/in")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        source = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"file://{tmp_path}/in")
        run_once(session_states(source), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {(r["conv_id"], r["turn"]): (r["history_size"], r["escalated"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {}
    for c in range(3):
        signals = []
        for n, (_, k, role, text) in enumerate(sorted(x for x in data if x[0] == c)):
            want[c, k] = (min(n + 1, 20), role == "user" and len(signals) >= 3 and all(signals[-3:]))
            signals += [text == "好难"] if role == "user" else []
    assert got == want and any(e for _, e in want.values())


def test_judges(spark):
    raw = ['{"level": "高危", "referent": "本人"}', 'so {"level": "高危", "referent": "他人"} ok', '{"level": "高危"}', "prose", None, '{"referent": "引用", "level": "正常"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    base = F.struct(F.lit("正常").alias("level"), F.lit("规则引擎").alias("source"), F.lit(0.6).alias("confidence"))
    got = df.orderBy("i").select(S.judged(base, F.col("raw")).alias("e"), S.referent_of(F.col("raw")).alias("r")).collect()
    assert [r["e"]["level"] for r in got] == ["高危", "正常", "正常", "正常", "正常", "正常"]
    assert [r["r"] for r in got] == ["本人", "他人", None, None, None, "引用"]


def test_containment_by_anchors(spark):
    """Evidence of every class of lengths in texts of few letters: pairs, first places and slices."""
    rng = np.random.default_rng(6)
    chunk_texts = ["".join(rng.choice(list("ab \n\u3000"), n)) for n in (40,) * 50 + (400,) * 12] + ["", None, "a" * 300, "ab" * 200, " \t"]
    long = [chunk_texts[i][j : j + n] for i, j, n in ((51, 10, 120), (52, 0, 400), (53, 300, 60), (54, 7, 33), (55, 100, 44), (1, 0, 40), (2, 5, 14))]
    items = ["".join(rng.choice(list("ab "), 5)) for _ in range(30)] + ["", " ", "ab", "a b", None, "a" * 40, "ba" * 30, "\U0001f600"] + long + ["".join(x.split()) for x in long] + [long[0]]
    chunks = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(chunk_texts)], "doc_id long, text string, slice string, owner int")
    evidence = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, evidence string")
    bare = lambda t: "".join(t.split())
    want = {}
    for i, t in enumerate(chunk_texts):
        for j, e in enumerate(items):
            if t and e and bare(e) and bare(e) in bare(t):
                at = [k for k, c in enumerate(t) if not c.isspace()]
                x = bare(t).index(bare(e))
                want[i, j] = (at[x], t[at[x] : at[x + len(bare(e)) - 1] + 1])
    rows = M.gold_pairs(evidence, chunks.drop("slice")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["slice"]) for r in rows}
    assert len(rows) == len(got) and got == want
    assert M.gold_pairs(evidence.limit(0), chunks).count() == 0
    assert M.gold_pairs(evidence.filter("item_id in (30, 31)"), chunks.limit(0)).count() == 0


def test_isolated_and_eligible(spark):
    rows = texts(spark, "the quick brown fox jumps", "another text altogether", "ab", None)
    other = spark.createDataFrame([(1, "The quick, brown fox jumps!")], "id long, text string")
    assert [r["id"] for r in D.isolated(rows, "id", F.col("text"), other, F.col("text")).collect()] == [1]
    docs = spark.createDataFrame([(1, "全部", "长期有效"), (2, "本科生", "长期有效"), (3, None, None), (4, "全部", "2026-2027秋季")], "id int, target_audience string, valid_semester string")
    assert sorted(r["id"] for r in D.eligible(docs).collect()) == [1, 3]
    chunks = spark.createDataFrame([(d, k) for d in range(20) for k in range(5)], "doc_id long, chunk_index int")
    one, two = ([(r["doc_id"], r["chunk_index"]) for r in D.candidates(chunks, 10, 2, seed).orderBy("place").collect()] for seed in ("1", "2"))
    assert len(one) == 18 and one != two and max(np.bincount([d for d, _ in one])) <= 2 and [d for d, _ in one] != sorted(d for d, _ in one)


def test_files_tables_and_reports(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert sinks.ensure_table(spark, f"{base}/m", "a long") == "created" and sinks.ensure_table(spark, f"{base}/m", "a long") == "kept"
    sinks.append(spark.createDataFrame([(1,)], "a long"), f"{base}/m")
    assert sinks.ensure_table(spark, f"{base}/m", "a long, b string") == "repaired"
    assert [tuple(r) for r in spark.read.parquet(f"{base}/m").select("a", "b").collect()] == [(1, None)]
    meta = F.struct(*[F.lit(k).alias(k) for k in ("title", "publish_date", "source_url", "target_audience", "valid_semester")])
    docs = texts(spark, "body\none", "body two").select(F.concat(F.lit("d"), "id", F.lit(".txt")).alias("file_name"), meta.alias("metadata"), "text")
    sinks.document_files(docs, f"{base}/docs")
    sinks.sidecar_files(docs, f"{base}/side")
    (part,) = (tmp_path / "docs" / "file_name=d0.txt").glob("part-*")
    assert part.read_text().rstrip("\0").startswith("【标题】title\n") and part.read_text().rstrip("\0").endswith("\n\nbody\none")
    (part,) = (tmp_path / "side" / "file_name=d1.txt.meta.json").glob("part-*")
    assert json.loads(part.read_text().rstrip("\0"))["source_url"] == "source_url"
    sinks.report(docs.select("file_name"), f"{base}/report", "csv")
    (part,) = (tmp_path / "report").glob("part-*")
    assert part.read_text().startswith("\ufefffile_name\n")
    sinks.provenance(spark, f"{base}/how", seed=42, corpora=["a", "b"])
    (part,) = (tmp_path / "how").glob("part-*")
    assert json.loads(part.read_text()) == {"seed": 42, "corpora": ["a", "b"]}
    (tmp_path / "eval.json").write_text(json.dumps([{"id": "r1", "question": "q", "source": {"doc": "d", "chunk_index": 3}, "evidence": "e"}]))
    (tmp_path / "faq.json").write_text(json.dumps([{"question": "q", "answer": "a", "tags": ["t"]}]))
    (tmp_path / "lab.json").write_text(json.dumps([{"text": "x", "label": "高危"}, {"text": "y", "label": "?"}]))
    assert corpus.read_evaluation(spark, f"{base}/eval.json").first()["source"]["chunk_index"] == 3
    assert corpus.read_faq(spark, f"{base}/faq.json").first()["similar_questions"] is None and corpus.read_evaluation(spark, f"{base}/no.json").count() == 0
    assert [r["text"] for r in corpus.read_labelled(spark, f"{base}/lab.json").collect()] == ["x"]
    files = spark.createDataFrame([("/a", 3, "2026-01-01 00:00:00", "t"), ("/b", 4, "2026-01-01 00:00:01", "u")], "path string, length long, at string, text string").withColumn("mtime", F.to_timestamp("at"))
    for _ in range(2):
        sinks.write_parse_cache(files.filter("path = '/a'"), f"{base}/cache")
    assert [r["path"] for r in corpus.uncached(files, spark.read.parquet(f"{base}/cache")).collect()] == ["/b"]


def test_list_page_addresses(spark):
    df = spark.createDataFrame([("http://h/a/list.htm", 1), ("http://h/a/list.htm", 3)], "u string, n int")
    assert [r["x"] for r in df.orderBy("n").select(H.list_page_url(F.col("u"), F.col("n")).alias("x")).collect()] == ["http://h/a/list.htm", "http://h/a/list3.htm"]


def test_small_operators(spark):
    df = spark.createDataFrame([("C:\\raw\\x.txt",), ("/data/a.b/x.txt",), ("/data/aXb/x.txt",)], "p string")
    from quillspark.functions import text as X

    assert [r["x"] for r in df.select(X.relative_path(F.col("p"), "/data/a.b").alias("x")).collect()] == ["C:/raw/x.txt", "x.txt", "/data/aXb/x.txt"]
    nested = spark.createDataFrame([([["13812345678", None], None],)], "a array<array<string>>")
    assert nested.select(X.sanitize_all(F.col("a"), 2).alias("x")).first()["x"] == [["[手机号]", None], None]
    hits = spark.createDataFrame([(1, 5, 0.5, 2), (1, 6, 0.9, 1)], "query_id long, id long, score double, rank int")
    rows = spark.createDataFrame([(5, "five"), (6, "six")], "id long, text string")
    assert [(r["rank"], r["text"]) for r in V.flattened(hits, rows, ("text",)).orderBy("rank").collect()] == [(1, "six"), (2, "five")]
    w = texts(spark, "good good day").select(V.sparse_map(P.LexicalEncoder().sparse(F.col("text"))).alias("m")).first()["m"]
    assert set(w) == {"good", "day"} and abs(w["good"] - 1.693147) < 1e-6
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y_true int, y_pred int")
    r = M.validation(df, (0, 1)).filter("label = 0").first()
    assert r["accuracy"] == 0.75 and abs(r["macro_f1"] - (0.8 + 0.666667) / 2) < 1e-6


def test_search_and_fusion(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>").repartition(5)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(7)], "query_id long, vec array<double>")
    for block in (4096, 3):
        got = {(r["query_id"], r["rank"]): r["id"] for r in V.dense_search(q, rows, 4, block=block).collect()}
        want = {(i, k + 1): int(j) for i in range(7) for k, j in enumerate(np.lexsort((np.arange(60), -np.round(m @ m[i], 6)))[:4])}
        assert got == want
    legs = [spark.createDataFrame(x, "query_id long, id long, rank int") for x in ([(1, 5, 1), (1, 6, 2)], [(1, 6, 1), (1, 7, 2)])]
    a, b = ([tuple(r) for r in V.rrf(x, 3).orderBy("rank").collect()] for x in (legs, legs[::-1]))
    assert a == b and [r[1] for r in a] == [6, 5, 7]
    hits = spark.createDataFrame([(1, 2, 0.85), (2, 3, 0.86)], "query_id long, id long, score double")
    assert {r["query_id"]: r["match_id"] for r in V.faq_match(hits).collect()} == {1: None, 2: 3}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y_true int, y_pred int")
    r = {x["label"]: x for x in M.classification_report(df, (0, 1, 2)).collect()}
    assert (r[1]["precision"], r[1]["recall"], r[2]["support"], r[2]["f1"]) == (1.0, 0.5, 0, 0.0)
    assert [tuple(x) for x in M.confusion(df, (0, 1)).orderBy("label").collect()] == [(0, 2, 0), (1, 1, 1)]
    assert not M.missed(df, 1).first()["gate"]
    means = M.metric_means(spark.createDataFrame([("a", 0.5), ("a", float("nan"))], "metric string, value double"), {"a": 0.5, "b": 1.0})
    assert {x["metric"]: (x["mean"], x["met"]) for x in means.collect()} == {"a": (0.5, True), "b": (None, False)}


def _grams(t):
    return {t[i : i + 3] for i in range(len(t) - 2)}


def test_near_pairs_and_greedy_are_exact(spark):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcd"), 40)) for _ in range(12)]
    rows = [b if rng.random() < 0.3 else b[: (k := rng.integers(1, 39))] + "x" + b[k:] for b in base for _ in range(4)] + ["", "ab"]
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (a := _grams(rows[i])) and (b := _grams(rows[j])) and len(a & b) / len(a | b) >= 0.8}
    df = texts(spark, *rows)
    pairs = D.near_pairs(df, "id", F.col("text"))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
    kept = []
    for i in range(len(rows)):
        if len(rows[i]) >= 3 and not any((k, i) in want for k in kept):  # shorter ones count as duplicates
            kept.append(i)
    assert sorted(r["id"] for r in D.greedy_kept(df, pairs, "id", F.col("text")).collect()) == kept


def test_keep_first_and_replace(spark):
    df = spark.createDataFrame([(1, "a", "s1"), (2, "a", "s2"), (3, "b", "s2")], "id int, k string, source_file string")
    assert sorted(r["id"] for r in D.keep_first(df, F.col("k"), ["id"]).collect()) == [1, 3]
    assert sorted(r["copy"] for r in D.oversampled(df, F.col("id") == 2).collect()) == [1, 1, 1, 2]


def test_scan_header_sidecar_and_sinks(spark, tmp_path):
    for folder, name, text in (("通知", "a.txt", "【标题】T\n【适用对象】本科生\n\n正文"), ("手册", "b.md", "# x"), ("其他", "c.pdf", "?"), ("表格", "d.txt", "【标题】only")):
        (tmp_path / "raw" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / folder / name).write_text(text)
    (tmp_path / "raw" / "root.txt").write_text("ignored")
    (tmp_path / "raw" / "手册" / "b.md.meta.json").write_text(json.dumps({"标题": "side", "适用对象": "研究生"}))
    (tmp_path / "raw" / "通知" / "a.txt.meta.json").write_text("{broken")
    good, bad = corpus.parsed(corpus.scan_files(spark, f"file://{tmp_path}/raw"))
    docs = corpus.with_metadata(good, corpus.read_sidecars(spark, f"file://{tmp_path}/raw"))
    got = {r["topic_tag"]: (r["doc_type"], r["text"], r["metadata"]["title"], r["metadata"]["target_audience"]) for r in docs.collect()}
    assert got == {"通知": ("通知", "正文", "T", "本科生"), "手册": ("手册", "# x", "side", "研究生"), "表格": ("表格", "【标题】only", "only", "全部")}
    assert bad.count() == 1
    chunks = K.by_type(docs.select("doc_type", "text", F.col("metadata.source_file").alias("source_file")))
    faq = corpus.read_faq(spark, f"file://{tmp_path}/none.json")
    out = f"file://{tmp_path}/index"
    first = sinks.build_index(chunks, faq, bad, out)
    sinks.build_index(chunks.filter("doc_type = '手册'"), faq, bad, out)
    assert first == {"chunk_count": 3, "faq_rows": 0, "failed_files": 1} and spark.read.parquet(f"{out}/chunks").count() == 3
    said = sinks.submit_alerts(docs.select("text"), f"file://{tmp_path}/alerts", notify=lambda df: 1 / 0)
    assert said["stored"] and not said["notified"]


def test_providers(spark):
    df = texts(spark, "good good day", None)
    v = [r["v"] for r in df.select(P.LexicalEncoder(8).dense(F.col("text")).alias("v")).collect()]
    assert sum(v[0]) == 3 and v[1] is None
    w = {x["token"]: round(x["weight"], 6) for x in df.select(P.LexicalEncoder().sparse(F.col("text")).alias("s")).first()["s"]}
    assert w == {"good": 1.693147, "day": 1.0}
    assert df.select(P.hop_name(["a", "b"], [F.lit(None), F.lit("x")]).alias("h")).first()["h"] == "b"


def test_patterns_stand_once_in_a_level(spark):
    """A level's expression reads the text a fixed number of times, however many results are made from it."""
    from quillspark.operators.providers import LexiconClassifier

    rule = S.rule_level(F.col("text"), ("scum", "vermin"), ("moron",), ("the scum", "the vermin"))
    level = S.fused(rule["level"], LexiconClassifier(("scum",), ("moron",), ("sad",)).probabilities(F.col("text")))
    plan = texts(spark, "the scum", "vermin", None).select(level["level"].alias("l"), level["confidence"].alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("the scum") <= 4 and plan.count("(?:sad)") <= 2  # once for each of the two columns and twice in a step
    got = texts(spark, "the scum", "vermin", "moron scum").select(rule["level"].alias("l"), rule["rule"].alias("r")).collect()
    assert [tuple(r) for r in got] == [(S.NORMAL, None), (S.HIGH, "vermin"), (S.HIGH, "scum")]


def test_hits_are_scored_on_stored_words(spark):
    """Chunks are split into words where they are stored: scoring a hit splits no text of a chunk again."""
    from quillspark.operators import routing

    asked = spark.createDataFrame([(1, "red apple", C.INTENTS[0], C.ROLES[0], C.ALWAYS)], "query_id long, text string, category string, user_role string, user_semester string")
    chunks = spark.createDataFrame([(7, "a red apple", C.EVERYONE, C.ALWAYS), (8, "red paint", C.EVERYONE, C.ALWAYS)], "id long, text string, audience string, valid string")
    out = routing.contexts_by_attempt(asked, chunks)
    assert out._jdf.queryExecution().analyzed().toString().count("split(lower(") == 1  # the request's own words
    got = {r["retry"]: [(c["rank"], c["id"]) for c in r["contexts"]] for r in out.collect()}
    assert got == {retry: [(1, 7), (2, 8)] for retry in range(C.active().max_retry + 1)}
