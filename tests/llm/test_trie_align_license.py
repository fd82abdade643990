"""op11 to op13 against brute force: whole tables, forced rounds, nulls, ties, repeated rows, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from quillspark.llm import alignment, licenses, prefix_trie, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, block int, stats string, tid int, rid string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    c = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return list(zip(c.doc_id.tolist(), c.text.tolist(), strict=True))


def texts_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], DOC)


def records(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# op11


def trie_of(rows, block=20, parts=4):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % parts
        source = c - (c % block if c >= 0 else -(-c % block))
        whole[c] = (*own.get(source, [])[:h], *t[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()),
        key=repr,
    )


def random_conversations(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-40, 400), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "a b", "c\td e", " \x0b "])))
    same = [(900 + i, t, "user", "w") for i in range(12) for t in range(5)]  # one sequence many times
    deep = [(2000 + 20 * i, t, "user", "same here" if t < 20 else f"end {i}") for i in range(10) for t in range(22)]  # a long shared beginning
    chain = [(4000 + 20 * i, t, "user", "x") for i in range(6) for t in range(i + 1)]  # each continues the one before
    return rows + same + deep + chain + rows[:25]


CONV = "conv_id long, turn long, role string, text string, words int, n string, ends string"


@pytest.mark.parametrize("local", [25, 10**6])
def test_trie_of_random_conversations(spark, local):
    rows = random_conversations(local)
    rows.append((None, 0, "user", "nobody's"))
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], CONV)
    assert records(prefix_trie.conversation_trie(df, local=local)) == trie_of(rows)


def test_trie_of_empty_and_turnless(spark):
    assert records(prefix_trie.conversation_trie(spark.createDataFrame([], CONV))) == []
    lone = next(c for c in range(1, 40) if zlib.crc32(str(c).encode()) % 4 and c % 20)
    rows = [(lone, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], CONV)
    got = records(prefix_trie.conversation_trie(df))
    assert got == trie_of(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_op11(spark):
    c = pq.read_table(f"{SF}/conversations.parquet").to_pandas()
    rows = list(zip(c.conv_id.tolist(), c.turn.tolist(), c.role, c.text, strict=True))
    assert records(queries.QUERIES["op11_prefix_trie"](spark, SF)) == trie_of(rows)


# op12


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))

    def encode(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        own = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
        other = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return own, [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i, p in other]

    return encode


def aligned(rows, encode):
    links, base = [], []
    for i, text in rows:
        a, b = encode(text) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(x[1] for x in a) != whole or b"".join(x[1] for x in b) != whole:
            base.append((i, 0, 0, 0, ""))
            links.append([])
            continue
        at_a, at_b = ([sum(len(x[1]) for x in side[: k + 1]) for k in range(len(side))] for side in (a, b)) if len(a) < 300 else (_ends(a), _ends(b))
        groups, x, y = [], 0, 0
        for e in sorted(set(at_a) & set(at_b)):
            p, q = x, y
            while p < len(a) and at_a[p] <= e:
                p += 1
            while q < len(b) and at_b[q] <= e:
                q += 1
            groups.append(",".join(str(t[0]) for t in a[x:p]) + "|" + ",".join(str(t[0]) for t in b[y:q]))
            x, y = p, q
        own, y = [], 0
        for k, (t, raw) in enumerate(a):
            while at_b[y] <= at_a[k] - len(raw):
                y += 1
            z = y
            while z < len(b) and at_b[z] - len(b[z][1]) < at_a[k]:
                own.append((t, b[z][0]))
                z += 1
        links.append(own)
        base.append((i, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for own in links for p in set(own))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return count, sorted(((i, na, nb, g, len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), sha) for (i, na, nb, g, sha), own in zip(base, links, strict=True)), key=repr)


def _ends(side):
    out, at = [], 0
    for _, raw in side:
        at += len(raw)
        out.append(at)
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "two  spaces"), (5, "a <|endoftext|> <s> </s> <unk> <0x41> b"), (6, "tab\there\nline"), (7, "日本語 und ½ é naïve \U0001f600"), (8, "▁marker"), (None, "no id at all"), (None, "no id at all"),
    (9, "the the the the"), (9, "the the the the"), (10, "ends with space "), (11, "\x00null"), (12, "ﬁ ligature ①"), (13, "word " * 3000 + "x" * 5000),
]


def test_alignment_of_odd_texts(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "TASK_LINKS", 50)  # bands are dealt over several tasks
    a, b = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    rows = ODD + documents()[:60]
    df = texts_frame(spark, rows)
    count, want = aligned(rows, sides)
    assert records(alignment.align(df, a, b)) == want
    size = alignment.sizes(a, b)
    pairs = alignment.pair_table(alignment.pair_counts(alignment.link_blocks(df, a, b), *size), *size).collect()
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    assert {(r["a"], r["b"]): (r["n_docs"], r["best"]) for r in pairs} == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_alignment_of_nothing(spark):
    a, b = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    assert records(alignment.align(texts_frame(spark, []), a, b)) == []
    assert records(alignment.align(texts_frame(spark, [(1, None), (2, "")]), a, b)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_blocks_of_a_task_are_summed_and_split(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 10)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    rows = documents()[60:100]
    try:
        got = records(alignment.align(texts_frame(spark, rows), queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == aligned(rows, sides)[1]


def test_op12(spark, sides):
    assert records(queries.QUERIES["op12_alignment"](spark, SF)) == aligned(documents(), sides)[1]


# op13

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def license_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in df), key=repr)


def test_op13(spark):
    got = queries.QUERIES["op13_licenses"](spark, SF).collect()
    assert license_rows(got) == sorted(((i, *license_base(t)) for i, t in documents()), key=repr)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 if r["n_base"] else True)
        assert r["labels"].split(",") == sorted(set(r["labels"].split(",")))


def test_licenses_of_odd_texts(spark):
    rows = [
        (1, None), (2, ""), (3, "MIT License"), (4, "mit\x00license; MIT-license, (MIT) License. MITlicense mit licensé mit license"), (None, "CC BY"), (None, "CC BY"), (5, "CC CC BY BY cc by"), (6, "permit license apache licenses"),
        (7, "GNU GNU General Public License general public license"), (8, "gnu general gnu general public license"), (9, "ＭＩＴ License ÀPACHE LICENSE"), (10, "word " * 200_000 + "MIT License " + "word " * 200_000 + "cc-by"), (11, "mit license mit license " * 5000),
    ]
    df = texts_frame(spark, rows)
    assert license_rows(licenses.scan(df).collect()) == sorted(((i, *license_base(t)) for i, t in rows), key=repr)
    assert records(licenses.scan(texts_frame(spark, []))) == []


def test_notices_are_found_with_changes_and_not_in_other_texts(spark):
    rng, rows, want = random.Random(5), [], {}
    filler = "the of and to in a is that this software with for free any use permission license rights copy without all such as".split()
    for n, (notice, label) in enumerate(licenses.NOTICES.items()):
        words = notice.split()
        some = list(words)
        for _ in range(max(1, len(words) // 16)):  # a word in 16 changed, put in or left out
            at = rng.randrange(len(some))
            some[at : at + 1] = rng.choice([[], [some[at], "indeed"], ["other"]])
        before = [rng.choice(filler) for _ in range(50)]
        rows += [(4 * n, " ".join([*before, *words, *before])), (4 * n + 1, " ".join([*before, *some]).title()), (4 * n + 2, " ".join([*before, *words[: len(words) // 3]])), (4 * n + 3, " ".join(rng.sample(words, len(words))))]
        want |= {4 * n: label, 4 * n + 1: label}
    got = {r["doc_id"]: r for r in licenses.scan(texts_frame(spark, rows)).collect()}
    for i, label in want.items():
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= licenses.LEAST_COVER
    for i in got.keys() - want.keys():
        found = set(filter(None, got[i]["labels"].split(",")))
        assert found <= {label for phrase, label in (licenses.BASE | licenses.PHRASES).items() if phrase in dict(rows)[i].lower()}
    spans = licenses.spans(texts_frame(spark, [rows[0]])).filter("tid >= 0").collect()
    assert [(r["first"], r["last"], r["cover"]) for r in spans] == [(50, 50 + len(next(iter(licenses.NOTICES)).split()), 1.0)]
