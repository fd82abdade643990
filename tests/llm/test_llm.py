"""The training-data operators against brute force, the libraries themselves and edge cases."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillspark.llm import crc, embed_dedup, langid, media, minhash, packing, pii, queries, sentencepiece_codec, substring, token_store, tokens, toxicity
from quillspark.llm.common import components, shared_dir

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", "Word", "x" * 3000, "ab " * 400, "a  b", " a", "a ", "a\nb", "é́ ﬁ", "a▁b", "\x00 a\x01b", "日本 語", "it's 12,345!", "tab\tx \n y",
    "<|endoftext|> </s>", "　x​", "same text here", "same text here",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, score double, ids string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None, "clash", 0.0, "clash") for i, t in enumerate(texts)], SCHEMA)


def corpus():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


def rows(df, key="doc_id"):
    out = {r[key]: r for r in df.collect()}
    return out


def test_chunk_tables_equal_the_libraries():
    texts = [t or "" for t in ODD] + corpus().text.tolist()[:60]
    for kind, name in ((tokens.ByteChunks, "byte_bpe_50k.json"), (tokens.WordChunks, "word_bpe_49k.json"), (tokens.PieceChunks, "piece_bpe_32k.model")):
        table = kind(queries.tokenizer_path(name))
        want = table.lib.encode(texts) if kind is tokens.PieceChunks else table.encode_all(texts)
        for _ in range(2):
            assert [np.frombuffer(r, "<u4").tolist() for r in table.encode(texts)] == [list(w) for w in want]


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 50)
    table = tokens.WordChunks(queries.tokenizer_path("word_bpe_49k.json"))
    for part in np.array_split(corpus().text.to_numpy()[:20], 5):
        assert [np.frombuffer(r, "<u4").tolist() for r in table.encode(list(part))] == table.encode_all(list(part))


def test_sentencepiece(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(sentencepiece_codec.encode_decode(docs(spark, ODD), path, ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")))
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["decoded"] == lib.decode(ids) and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_crc_join():
    rng, j = np.random.default_rng(0), crc.Joiner(3)
    for n in (0, 1, 4, 63, 1000):
        a, b = rng.bytes(17), rng.bytes(n)
        assert j.join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_token_store(spark):
    texts = ODD + corpus().text.tolist()
    path, tok = shared_dir(spark), queries.tokenizer_path("word_bpe_49k.json")
    token_store.write_store(docs(spark, texts).repartition(3), path, tok, end_id=1)
    lib = tokens.WordChunks(tok)
    got, start = rows(token_store.read_back(spark, path)), 0
    whole = rows(token_store.read_ids(spark, path))
    for i, t in enumerate(texts):
        ids = [*lib.encode_all([t or ""])[0], 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[i]["ids"] == ids
        start += len(ids)
    assert token_store.broken_shards(spark, path).count() == 0
    keys = [r["key"] for r in spark.read.parquet(f"{path}/objects/kind=1").select("key").collect()]
    assert len(keys) == len(set(keys))
    order = [r["doc_id"] for r in spark.read.parquet(f"{path}/recipes").orderBy("start").collect()]
    assert order == sorted(order)


def test_token_store_holds_recipes_against_the_manifest(spark):
    path, tok = shared_dir(spark), queries.tokenizer_path("word_bpe_49k.json")
    token_store.write_store(docs(spark, ODD).repartition(3), path, tok, end_id=1)
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    for r in manifest.collect():
        own = recipes.filter(f"shard = {r['shard']}").orderBy("doc_id").collect()
        assert bytes(r["root"]) == token_store.merkle([bytes(x["root"]) for x in own])
    some = recipes.first()["doc_id"]
    first = recipes.first()["shard"]
    for name, cut_recipes, cut_manifest in (
        ("a recipe is gone", recipes.filter(f"doc_id <> {some}"), manifest),
        ("a shard is gone", recipes.filter(f"shard <> {first}"), manifest),
        ("a manifest row is gone", recipes, manifest.filter(f"shard <> {first}")),
    ):
        bad = shared_dir(spark)
        spark.read.parquet(f"{path}/objects").write.partitionBy("kind").parquet(f"{bad}/objects")
        cut_recipes.write.parquet(f"{bad}/recipes")
        cut_manifest.write.parquet(f"{bad}/manifest")
        with pytest.raises(ValueError, match="shard"):
            token_store.read_back(spark, bad).collect()
            pytest.fail(name)


def test_shared_passages_become_chunks():
    rng = np.random.default_rng(4)
    stored, total = {}, 0
    for k in range(400):
        passage = np.random.default_rng(k // 8).integers(0, 49_000, 600)  # each passage in eight documents
        ids = np.concatenate([rng.integers(0, 49_000, rng.integers(50, 400)), passage, rng.integers(0, 49_000, rng.integers(50, 400))])
        ends = token_store.cut_points(ids)
        stored |= {ids[i:j].tobytes(): j - i for i, j in zip([0, *ends], ends, strict=False)}
        total += len(ids)
    assert sum(stored.values()) < 0.88 * total


def test_media(spark):
    got = rows(media.analysed(media.media_column(docs(spark, ODD))))
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        wav = media.pack(pay)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(pay[-64:]), len(wav), hashlib.sha256(wav).hexdigest())
        assert len(r["fp_times"]) == len(r["fp_codes"]) and r["fp_times"] == sorted(r["fp_times"])
    assert got[20]["feature"] == got[21]["feature"] != got[6]["feature"]


def test_fingerprint_finds_a_tone():
    x = np.arange(64 * 40)
    times, codes, peaks = media.fingerprint((128 + 100 * np.sin(2 * np.pi * 8 * x / 64)).astype(np.uint8))
    assert peaks >= 40 and (np.bincount(codes >> 12).argmax()) == 8 and len(times)


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            bad = (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15)
            if not bad:
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans():
    rng = np.random.default_rng(3)
    alphabet = list("a@.-+12 (9)0Z_%é")
    for _ in range(5000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 30)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert all(pii.base_spans(t) == plain_spans(t) for t in corpus().text)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_tagger_gradients_and_use(spark):
    model = pii.SpanTagger(hidden=3, dim=4)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, pii.CLASSES, (2, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0, 0, 5, 6, 6, 0, 1]])
    _, g = model.loss(ids, tags)
    for k, at in {"wf": (1, 2), "ub": (0, 5), "out": (2, 1), "trans": (0, 1), "emb": (int(ids[0, 0]), 1)}.items():
        old = model.p[k][at]
        model.p[k][at] = old + 1e-5
        up = model.loss(ids, tags)[0]
        model.p[k][at] = old - 1e-5
        down = model.loss(ids, tags)[0]
        model.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5
    texts = [*ODD, "mail ann.lee@mail.example.com or +1 (212) 555-0147", "see 10.20.30.40 and 4539 1488 0343 6467"]
    fitted = pii.fit(docs(spark, texts), steps=150)
    got = rows(pii.find(docs(spark, texts), fitted))
    for i, t in enumerate(texts):
        base = [(s["start"], s["end"], pii.KINDS.index(s["kind"])) for s in got[i]["base"]]
        assert base == plain_spans(t or "") and {tuple(s) for s in got[i]["base"]} <= {tuple(s) for s in got[i]["spans"]}
    assert rows(pii.mask(docs(spark, texts), fitted))[22]["text"] == "mail [EMAIL] or [PHONE]"
    # long segments: windows are reconciled into one path of the segment's length
    assert [len(x) for x in fitted.decode([np.ones(1000, np.int64), np.ones(3, np.int64)])] == [1000, 3]


def test_added_emails_are_whole():
    class Tagger:
        def decode(self, segments):
            return [np.array([1] + [2] * (len(s) - 1)) for s in segments]

    local, host = "a-rather-long-name.of-somebody", "mail.department-of-long-names.example.org"
    address = f"{local} @ {host}"
    for text in (address, f"({address})", f"<{address}>.", f"write:{address}."):
        a = text.index(local)
        assert pii.all_spans([text], Tagger()) == [([], [(a, a + len(address), 0)])]


def test_language(spark):
    c = corpus()
    df = docs(spark, ODD).unionByName(spark.createDataFrame([(1000 + i, t, lang, "s", None, "x", 0.0, "x") for i, t, lang in zip(c.doc_id.tolist(), c.text, c.lang)], SCHEMA))
    model = langid.fit(df.filter("doc_id >= 1000"))
    got = rows(langid.identify(df, model))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert np.mean([got[1000 + i]["lang_pred"] == lang for i, lang in zip(c.doc_id, c.lang)]) > 0.97
    assert got[4]["source"] == "s" and all(0 <= r["score"] <= 1 for r in got.values())
    assert rows(langid.identify(df, langid.fit(df.limit(0))))[1000]["lang_pred"] == "und"


def test_language_learns_every_label(spark):
    rng = np.random.default_rng(2)
    names = [f"l{k:02d}" for k in range(19)]
    vocab = {n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for n in names}

    def text(n, size):
        return " ".join(rng.choice(vocab[n], size))

    data = [(k, text(n, 60), n) for k, n in enumerate(names * 6)]
    data += [(1000 + k, text("l18", 60), "l18") for k in range(30)]
    # a language of long texts only, and one of one text in many copies
    long_words = ["qqzzq", "wxxwq", "zzxqw"]
    data += [(2000 + k, " ".join(rng.choice(long_words, 5000)), "long") for k in range(3)]
    data += [(3000, "ÿþÿ ðøð ÿøÿ", "copies")] * 40
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df, max_docs=10)
    assert model.langs == sorted({*names, "long", "copies"})
    got = langid.identify(df, model).toPandas()
    assert (got.lang_pred == got.lang).all()
    only_long = langid.fit(df.filter("lang = 'long'"))
    assert only_long.predict([" ".join(long_words)])[0] == ["long"]


def test_toxicity_neighbours_are_exact(spark):
    rng = np.random.default_rng(5)
    bad, good = ["loser", "idiot", "scum"], [f"word{chr(97 + i)}" for i in range(20)]
    texts, labels = [], []
    for i in range(240):
        y = i % 2
        texts.append(" ".join([*rng.choice(good, 12), *(rng.choice(bad, 2) if y else [])]))
        labels.append(y)
    m = toxicity.NearestExamples(list(range(240)), texts, labels)
    dense = np.zeros((240, len(m.terms)))
    dense[m.post_doc, np.repeat(np.arange(len(m.terms)), np.diff(m.cells[:: m.blocks]))] = m.post_val
    for t in texts[:40]:
        at, w = m.vector(t)
        cos = dense[:, at] @ w if len(at) else np.zeros(240)
        want = np.lexsort((np.arange(240), -np.round(cos, 12)))[: toxicity.K]
        assert m.neighbours(at, w)[0].tolist() == [i for i in want.tolist() if cos[i] > 0]
    df = docs(spark, [*texts, None, ""])
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    got = rows(toxicity.score_toxicity(df, toxicity.fit(df, known)))
    assert all(got[i]["predicted"] == labels[i] for i in range(240)) and got[0]["source"] == "s"
    assert got[240]["score"] == got[241]["score"] and 0 <= got[240]["score"] <= 1 and got[1]["evidence"][0]["label"] == 1
    assert rows(toxicity.score_toxicity(df, toxicity.fit(df, known.limit(0))))[0]["score"] == 0


def test_toxicity_counts_all_documents_and_terms(spark):
    rng = np.random.default_rng(6)
    words = ["".join(w) for w in itertools.product("bcdfghjklmnpqrst", "aeiou", "vwxz", "aeiouy")]  # 1920 words of four letters
    texts = [" ".join([*(w for w in words if rng.random() < 0.5), *(f"{w}q" for w in words if rng.random() < 0.5)]) if i % 2 else "plain words of no label" for i in range(120)]
    m = toxicity.NearestExamples(list(range(120)), texts, [i % 2 for i in range(120)])
    assert {*words, *(f"{w}q" for w in words)} <= {*m.terms}
    texts = [f"{'loser scum' if i % 2 else 'fine day'} {i}" for i in range(240)]
    more = ["a loser again", "Loser loser", "scum", None, "", "nothing"] * 200
    df = docs(spark, [*texts, *more]).repartition(5)
    known = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, toxic int")
    m = toxicity.fit(df, known)
    whole = [{x for tok in t.lower().split() for x in toxicity.terms_of(tok)} for t in [*texts, *more] if t is not None]
    assert {"loser", "scum"} <= {*m.terms}
    for t, i in m.terms.items():
        assert abs(m.idf[i] - np.log((1 + len(whole)) / sum(t in w for w in whole)) - 1) < 1e-12


def plain_substring(texts, width):
    words = {i: (t or "").encode().split() for i, t in enumerate(texts)}
    first, out = {}, {}
    for i, w in words.items():
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), (i, p))
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] != (i, p):
                gone |= set(range(p, p + width))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_substring(spark, block):
    rng = np.random.default_rng(7)
    vocab = list("abcdefghij")
    passage = " ".join(rng.choice(vocab, 30))
    texts = [*ODD, *(" ".join([*rng.choice(vocab, rng.integers(0, 20)), *(passage.split() if rng.random() < 0.5 else []), *rng.choice(vocab, 5)]) for _ in range(60)), "a " * 50]
    got = rows(substring.remove_repeats(docs(spark, texts).repartition(5), width=6, block_windows=block, carry=("target", "ids")))
    for i, want in plain_substring(texts, 6).items():
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept"]) == want and r["target"] == "clash"
        assert sum(x["end"] - x["first"] for x in r["intervals"]) == r["n_removed"]


def test_substring_repeated_rows_and_nulls(spark):
    t = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in substring.remove_repeats(df, width=5).collect()))
    assert got == [(False, 0, 0), (True, 1, 30), (True, 1, 30), (True, 2, 30), (True, 3, 0)]
    assert substring.remove_repeats(df.limit(0)).count() == 0


def plain_components(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_components(spark):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    want = plain_components(261, links)
    got = rows(components(spark.createDataFrame(links, "a long, b long").repartition(6)), "node")
    assert {k: r["component_id"] for k, r in got.items()} == {i: want[i] for i in {x for p in links if p[0] != p[1] for x in p}}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width, monkeypatch):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = list(rng.choice(vocab, rng.integers(8, 120)))
        for _ in range(8):
            w = list(base)
            for _ in range(rng.integers(0, 6)):
                w[rng.integers(0, len(w))] = str(rng.choice(vocab))
            texts.append(" ".join(w))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = (t or "").translate(lower).encode().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    monkeypatch.setattr(minhash, "BLOCK", 3)
    got = rows(minhash.near_duplicates(docs(spark, texts).repartition(4), width=width))
    want = plain_components(len(texts), links)
    assert [got[i]["component_id"] for i in range(len(texts))] == want and len(links) > 30
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert minhash.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0


def test_near_duplicates_with_unlucky_sketches(spark):
    words = [f"w{i}" for i in range(400)]
    words.sort(key=lambda w: int(minhash.shingle_sets([w], 1)[0][0]))
    texts = []
    # S: both sets hold the value, U: one of them; in rising order of the values
    for pool, marks in ((words[:200], "U" * 8 + "S" * 60), (words[200:], "SS" + "U" * 10 + "S" * 11 + "U" * 9 + "S" * 118)):
        own = list(zip(pool, marks, strict=False))
        texts += [" ".join(w for k, (w, m) in enumerate(own) if m == "S" or k % 2 == side) for side in (0, 1)]
        assert marks.count("S") >= 0.8 * len(marks)
    got = rows(minhash.near_duplicates(docs(spark, texts), width=1))
    assert [got[i]["component_id"] for i in range(4)] == [0, 0, 2, 2]


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(13)
    m = rng.normal(size=(60, 16))
    m = np.concatenate([m, m[:20] + 0.05 * rng.normal(size=(20, 16)), m[:6], np.zeros((1, 16))]).astype(np.float32)
    data = [(i, v.tolist(), i % 2 if i < 80 else 0) for i, v in enumerate(m)]
    data += [(100, None, 0), (101, [1.0, float("nan")], 0), (102, m[0].tolist(), None), (103, [1.0, 2.0], 0), (104, [2.0, 4.0], 0), (105, [None, 1.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    got = rows(embed_dedup.link_embeddings(df), "vec_id")
    good = [(i, np.array(v, np.float64), y) for i, v, y in data if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for (a, x, p), (b, y, q) in itertools.combinations(good, 2) if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    n, want = np.zeros(106, int), plain_components(106, links)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(links) > 10 and {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (n[i], want[i]) for i, _, _ in data}


def test_packing(spark):
    texts = [*ODD, *corpus().text.tolist()]
    tok = queries.tokenizer_path("byte_bpe_50k.json")
    packed = packing.pack(docs(spark, texts).repartition(3), tok, capacity=256, with_ids=True)
    got = packed.toPandas().sort_values(["doc_id", "piece"])
    lib = tokens.ByteChunks(tok)
    for i, t in enumerate(texts):
        ids = [*lib.encode_all([t or ""])[0], 2]
        own = got[got.doc_id == i]
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids
        assert own.start.tolist() == (np.cumsum(own.length) - own.length).tolist() and (own.length.iloc[1:] == 256).all()
        assert [zlib.crc32(x) for x in own.ids] == own.ids_crc32.tolist()
    by = got.sort_values(["sequence_id", "offset"])
    assert ((by.groupby("sequence_id").length.cumsum() - by.length) == by.offset).all()
    fill = by.groupby("sequence_id").length.sum()
    assert fill.max() <= 256 and len(fill) <= 1.02 * -(-got.length.sum() // 256) + 1
    assert {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(packed).collect()} == fill.to_dict()
    assert packing.pack(docs(spark, ["x"]).limit(0), tok).count() == 0


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300).tolist()
    a, b = (packing.best_fit(rng.permutation(300).tolist(), sizes, packing.Bins(100)) for _ in range(2))
    for _ in range(20):
        child = packing.cross(a, b, sizes, rng)
        assert sorted(i for items in child.items for i in items) == list(range(300))
        assert all(sum(sizes[i] for i in items) + room == 100 for items, room in zip(child.items, child.room, strict=True))
        a, b = b, child


def test_language_fit_takes_null_ids(spark):
    df = spark.createDataFrame([(None, "alpha beta", "en"), (1, "gamma delta", "en"), (None, "eins zwei", "de"), (2, "drei vier", "de")], "doc_id long, text string, lang string")
    assert langid.fit(df).predict(["alpha gamma", "eins drei"])[0] == ["en", "de"]
    named = df.withColumn("doc_id", df.doc_id.cast("string"))
    assert langid.fit(named).langs == ["de", "en"]


def test_pipeline_keeps_null_ids(spark):
    import corpus_pipeline as cp
    from quillspark.llm.common import stored

    c = corpus()
    data = [(i, t, lang, "s", len(t)) for i, t, lang in zip(c.doc_id.tolist(), c.text, c.lang) if re.search(r"[^\W\d_]", t)][:60]
    words = data[0][1].split()[:30]
    nameless = [" ".join(words), " ".join(reversed(words)), "a note of no name", "a note of no name"]
    rows = data + [(None, t, data[0][2], "s", len(t)) for t in nameless]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, stage in cp.STAGES[:4]:
        frame = stored(stage(spark, frame, SF), name)
        assert sorted(r["text"] for r in frame.filter("doc_id is null").collect()) == sorted(nameless), name
    packed = cp.STAGES[4][1](spark, frame, SF)
    lib = tokens.ByteChunks(queries.tokenizer_path("byte_bpe_50k.json"))
    assert sorted(r["length"] for r in packed.filter("doc_id is null").collect()) == sorted(len(x) + 1 for x in lib.encode_all(nameless))


def test_pipeline_rejects_texts_of_no_known_language(spark):
    import corpus_pipeline as cp

    c = corpus()
    c = c[[bool(re.search(r"[^\W\d_]", t)) for t in c.text]]
    good = [(i, t, lang, "s", len(t)) for i, t, lang in zip(c.doc_id.tolist(), c.text, c.lang)]
    good += [(10_000 + i, t[:40], lang, "s", 40) for i, t, lang, _, _ in good if len({*t[:40].split()}) > 3]  # short and clean
    key = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
    good.append((20_000, f'token = "{key}" {good[0][1][:40]}', good[0][2], "s", 90))
    foreign = ["xqzt vvkj wprq zzxk qjwv the", "Ez egy magyar szöveg az időjárásról", "To jest zwykły polski tekst o pogodzie i zdrowiu", "Привет мир, это русский текст"]
    rows = good + [(30_000 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in cp.language(spark, df, SF).collect()} == {r[0] for r in good}


def test_pipeline(spark):
    import corpus_pipeline as cp
    from quillspark.llm.common import stored, table

    kept, frame = [], table(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in frame.collect()}
    for _, stage in cp.STAGES:
        frame = stored(stage(spark, frame, SF))
        kept.append(frame)
    lang, near, passages, masked, packed = kept
    assert all(tuple(f.columns) == cp.COLUMNS for f in kept[:4])
    ids = lambda f: {r["doc_id"] for r in f.select("doc_id").distinct().collect()}
    assert ids(lang) == {i for i, t in before.items() if re.search(r"[^\W\d_]", t)}
    sets = {}
    for i in sorted(ids(lang)):
        w = before[i].lower().encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    order = sorted(sets)
    links = [(a, b) for a, b in itertools.combinations(range(len(order)), 2) if 100 * len(sets[order[a]] & sets[order[b]]) >= 80 * len(sets[order[a]] | sets[order[b]])]
    root = plain_components(len(order), links)
    assert ids(near) == {order[r] for r in set(root)}
    left = sorted(ids(near))
    cut = plain_substring([before[i] for i in left], 20)
    want = {left[k]: (c if removed else before[left[k]]) for k, (n, removed, c) in cut.items() if removed == 0 or removed < n}
    assert {r["doc_id"]: r["text"] for r in passages.collect()} == want
    for r in masked.collect():
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert ids(packed) == ids(masked) == ids(passages)
    assert cp.run(spark, SF).count() == packed.count()


def test_pipeline_near_duplicates_join_by_sorting(spark):
    """Ids of the texts that stay have no bound: the join's form must not change with the size of the table."""
    from pyspark.sql import functions as F

    import corpus_pipeline

    df = docs(spark, ["one text of some words", "another text of other words"])
    df = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    out = corpus_pipeline.near_duplicates(spark, df, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1]


def test_a_new_word_takes_few_steps():
    """Python calls that a word takes when a table meets it for the first time."""
    import cProfile
    import pstats

    import public_tokenizers

    table = tokens.WordChunks(public_tokenizers.path("word_bpe_49k.json"))
    words = ["".join("abcdefghij"[int(x)] for x in f"{i:05}") + mark for i in range(10_000) for mark in (",", "")]
    text, profile = " ".join(words), cProfile.Profile()
    profile.enable()
    got = table.encode([text])
    profile.disable()
    assert got == [np.array(table.encode_all([text])[0], "<u4").tobytes()]
    assert pstats.Stats(profile).total_calls < 9 * len(words)  # 11 before words were looked up by arrays
