"""The queries opN_<name> over the whole tables, with production parameters, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, shared_dir, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(col: str, parts: int, rest: int):
    """Whether the id's crc32 leaves that rest; rows without an id are held out, that is, not learned from."""
    return F.coalesce(crc_mod(col, parts) == rest, F.lit(True)).alias("held_out")


def op1_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import link_embeddings

    return link_embeddings(table(spark, sf_dir, "embeddings"), least=0.93)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import analysed, media_column

    return analysed(media_column(table(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find, fit

    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_back, write_store

    path = shared_dir(spark)
    write_store(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_back(spark, path)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 3, 1))
    model = fit(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 5, 0))
    model = fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", "evidence")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), outputs=("n_words", "n_removed", "kept_sha256"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embed_dedup, op2_packing, op3_media, op4_pii, op5_sentencepiece, op6_token_store, op7_language, op8_toxicity, op9_substring_dedup, op10_minhash, op11_prefix_trie, op12_alignment, op13_licenses,
    )
}
#: Shared by the oracles: the smallest node that each node of links (a, b) reaches.
_REACH = """
  both_ways as (select a, b from links union select b, a from links),
  reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
  lowest as (select a, least(a, min(b)) as component_id from reach group by a)"""

#: DuckDB SQL of the queries that it can express. The others (packing, media, trained models, tokenizer
#: libraries) are held against brute force and the libraries in tests/llm.
ORACLE: dict[str, str] = {
    "op1_embed_dedup": f"""
with recursive
  v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
  good as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as size from v
           where label is not null and e is not null and len(e) > 0
             and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_dot_product(e, e) > 0),
  links as (select p.vec_id as a, q.vec_id as b from good p join good q
            on p.label = q.label and p.vec_id < q.vec_id and len(p.e) = len(q.e)
            where list_dot_product(p.e, q.e) / (p.size * q.size) >= 0.93),{_REACH},
  n as (select a, count(*) as n_links from both_ways group by a)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id,
       coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join n on n.a = vec_id left join lowest on lowest.a = vec_id""",
    "op11_prefix_trie": r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn,
             sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as x
           from conversations where conv_id is not null),
  numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, x) as p from t),
  c as (select conv_id, conv_id - conv_id % 20 as source,
          xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end), 4294967295::bigint) % 4 as h
        from (select distinct conv_id from t)),
  both_parts as (select c.conv_id, 0 as part, n.p, n.x, n.text from c join numbered n on n.conv_id = c.source and n.p <= c.h
                 union all select c.conv_id, 1, n.p, n.x, n.text from c join numbered n on n.conv_id = c.conv_id and n.p > c.h),
  rebuilt as (select conv_id, text, row_number() over w as d, string_agg(x, '/') over (partition by conv_id order by part, p rows unbounded preceding) as path
              from both_parts window w as (partition by conv_id order by part, p)),
  member as (select conv_id, d, path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from rebuilt union all select conv_id, 0, '', 0 from c),
  node as (select path, d, min(conv_id) as conv_id, count(*) as n, any_value(words) as words, case when d < 2 then '' else left(path, 65 * (d - 1) - 1) end as up from member group by path, d),
  kids as (select up, count(*) as n_children from node where d > 0 group by up),
  ends as (select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha from (select conv_id, arg_max(path, d) as path from member group by conv_id) group by path),
  below as (select a.d, case when a.e = 0 then '' else left(a.path, 65 * a.e - 1) end as path, a.e, leaf, saved
            from (select path, d, unnest(range(0, d + 1)) as e, case when n_children is null then 1 else 0 end as leaf, (n - 1) * words as saved from node left join kids on kids.up = path) a),
  total as (select path, sum(leaf) as n_leaves, sum(saved) as saved from below group by path)
select node.conv_id, node.d as depth, parent.conv_id as parent_conv_id, node.n as n_convs, coalesce(n_children, 0) as n_children, n_leaves::bigint as n_leaves,
       saved::bigint as saved_tokens, coalesce(ends.sha, sha256('')) as ends_sha256
from node left join node parent on node.d > 0 and parent.path = node.up and parent.d = node.d - 1 left join kids on kids.up = node.path
     join total on total.path = node.path left join ends on ends.path = node.path""",
    "op9_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
  win as (select doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') as g
          from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from w where len(w) >= 20)),
  ranked as (select doc_id, p, row_number() over (partition by g order by doc_id, p) as r from win),
  gone as (select distinct doc_id, unnest(range(p, p + 20)) as k from ranked where r > 1),
  word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as k from w),
  kept as (select word.doc_id, count(*) as n, string_agg(x, ' ' order by word.k) as t
           from word left join gone on gone.doc_id = word.doc_id and gone.k = word.k where gone.k is null group by word.doc_id)
select w.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id""",
    "op10_minhash": r"""
with recursive
  w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  s as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end as s from w),
  one as (select doc_id, len(s) as n, unnest(s) as x from s),
  shared as (select p.doc_id as a, q.doc_id as b, p.n as na, q.n as nb, count(*) as i from one p join one q
             on p.x = q.x and p.doc_id < q.doc_id and 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) group by all),
  links as (select a, b from shared where 100 * i >= 80 * (na + nb - i)),"""
    + _REACH
    + """
select doc_id, len(s) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
from s left join lowest on lowest.a = doc_id""",
}
