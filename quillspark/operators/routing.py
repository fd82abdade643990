"""The turn program: routes, language, quality retries, prompts, history, and answer() over a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from ..functions.text import json_object, strip, tail
from . import index as I
from . import vector as V
from .tables import scratch
from .providers import LexiconClassifier, OverlapReranker, words
from .safety import HIGH, MILD, MID, any_of, fused, known_or, rule_levels


def after_emotion(level: Column) -> Column:
    return F.when(level == HIGH, "report").otherwise("intent_route")


def after_intent(category: Column) -> Column:
    return F.when(category == C.INTENTS[1], "plan_and_retrieve").when(category == C.INTENTS[3], "chitchat_response").otherwise("retrieve")


def after_retrieve(hit: Column) -> Column:
    return F.when(hit.isNotNull(), "care_suffix").otherwise("generate")


def after_quality(passed: Column) -> Column:
    return F.when(passed, "care_suffix").otherwise("retrieve")


def after_suffix(category: Column) -> Column:
    return F.when(category == C.INTENTS[3], "end").otherwise("memory_write")


def intent(raw: Column, user_input: Column) -> Column:
    """struct<category, rewritten_query>; unreadable answers give the simple category and the input."""
    v = json_object(raw)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    category = known_or(get("category"), C.INTENTS, F.lit(C.INTENTS[0]))
    return F.struct(category.alias("category"), F.coalesce(F.nullif(F.trim(get("rewritten_query")), F.lit("")), user_input).alias("rewritten_query"))


def session_language(turns: DataFrame) -> DataFrame:
    """Latest valid request, else the language the session came with, else Chinese; high turns do not count.

    turns: session, turn, level, requested, input_language.
    """
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    reaches = F.coalesce(F.col("level"), F.lit("")) != HIGH
    asked = F.last(F.when(reaches & F.col("requested").isin(*C.LANGUAGES), F.col("requested")), ignorenulls=True).over(w)
    came = F.first(F.when(F.col("input_language").isin(*C.LANGUAGES), F.col("input_language")), ignorenulls=True).over(w)
    return turns.withColumn("language", F.coalesce(asked, came, F.lit(C.LANGUAGES[0])))


@C.configured
def quality(verdicts: Column, most: int = C.setting("max_retry")) -> Column:
    """struct<retry_count, score, forced> of verdicts array<struct<passed, score>>, one an attempt.

    A missing verdict passes; the attempt after the last retry is forced with score 0.5.
    """
    out = F.struct(F.lit(most).alias("retry_count"), F.lit(0.5).alias("score"), F.lit(True).alias("forced"))
    for i in reversed(range(most)):
        v = F.get(verdicts, i)
        out = F.when(
            F.coalesce(v["passed"], F.lit(True)), F.struct(F.lit(i + 1).alias("retry_count"), F.coalesce(v["score"], F.lit(0.5)).cast("double").alias("score"), F.lit(False).alias("forced"))
        ).otherwise(out)
    return out


def sources_block(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n---\n\n")


def prompt(question: Column, chunks: Column, history: Column, memories: Column, language: Column) -> Column:
    said = F.transform(tail(history, C.active().history_rounds), lambda m: F.concat_ws(": ", m["role"], m["content"]))
    parts = F.array(sources_block(chunks), F.array_join(said, "\n"), F.array_join(F.slice(memories, 1, 3), "\n"), language, question)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


@C.configured
def care_suffix(level: Column, language: Column, written: Column | None = None, info: str = C.setting("care_info")) -> Column:
    """Suffix for mild and middle levels: the service's words, else the template; "" otherwise."""
    english = language == C.LANGUAGES[1]
    pick = lambda t: F.when(english, t["English"].format(care_info=info)).otherwise(t["中文"].format(care_info=info))
    template = F.when(level == MILD, pick(C.CARE_MILD)).when(level == MID, pick(C.CARE_MODERATE))
    return F.coalesce(F.when(template.isNotNull(), written) if written is not None else F.lit(None), template, F.lit(""))


def final_response(response: Column, suffix: Column) -> Column:
    return F.when(suffix != "", F.concat_ws("\n\n", response, suffix)).otherwise(response)


@C.configured
def crisis_reply(written: Column, info: str = C.setting("care_info")) -> Column:
    return F.coalesce(F.nullif(F.trim(written), F.lit("")), F.lit(C.CRISIS_TEXT.format(care_info=info)))


@C.configured
def history_after(history: Column, user: Column, answer: Column, rounds: int = C.setting("history_rounds")) -> Column:
    said = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return tail(F.concat(history, F.array(said("user", user), said("assistant", answer))), 2 * rounds)


def memory_summary(written: Column, user: Column, answer: Column) -> Column:
    plain = F.concat(F.lit("用户："), F.left(user, F.lit(30)), F.lit("；助手："), F.left(answer, F.lit(30)))
    return F.coalesce(F.nullif(F.trim(written), F.lit("")), plain)


@C.configured
def valid_request(role: Column, text: Column, chars: tuple = C.setting("request_chars")) -> Column:
    """Whether a row is a user's request of an allowed length."""
    return F.coalesce((role == "user") & F.length(text).between(*chars), F.lit(False))


@C.configured
def kept_history(turns: DataFrame, rounds: int = C.setting("history_rounds")) -> DataFrame:
    """The messages of each conversation that its history still holds after the last one."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= 2 * rounds).drop("back")


def response_source(level: Column, category: Column, match_id: Column, contexts: Column) -> Column:
    """Where a reply comes from: crisis, chitchat, faq, generated or fallback."""
    out = F.when(level == HIGH, "crisis").when(category == C.INTENTS[3], "chitchat").when(match_id.isNotNull(), "faq")
    return out.when(F.size(contexts) > 0, "generated").otherwise("fallback")


def reply_in(texts: dict[str, str], language: Column) -> Column:
    """A fixed reply in the session's language."""
    s = C.active()
    filled = {k: v.format(school=s.school, care_info=s.care_info) for k, v in texts.items()}
    return F.when(language == C.LANGUAGES[1], filled["English"]).otherwise(filled["中文"])


def recent_memories(memories: DataFrame, n: int = 5, user: str = "user_id", at: str = "created_at", tie: str = "id") -> DataFrame:
    w = Window.partitionBy(user).orderBy(F.desc(at), F.desc(tie))
    return memories.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def word_weights(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Distinct words of a text with the weight 1 + ln(count): keys, token, weight."""
    rows = df.select(*keys, F.explode(words(text)).alias("token"))
    return rows.groupBy(*keys, "token").agg((1 + F.log(F.count("*").cast("double"))).alias("weight"))


FAQ_VARIANTS = 1 << 12  # forms of one entry's question at most


@C.configured
def faq_hits(asked: DataFrame, faq: DataFrame, threshold: float = C.setting("faq_threshold"), verify: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """query_id, match_id, faq_answer: the entry one of whose questions has the largest share of its words in the
    request or in its rewritten form, above the threshold (of equals the request's, the smaller entry).

    asked: query_id, text, rewritten. verify gives two conditions (same question, answered) from the request and
    the entry's question; a match that fails one of them is none."""
    entries = V.faq_index(faq)
    index = entries.withColumn("w", F.array_distinct(words(F.col("indexed")))).filter(F.size("w") > 0)
    place = F.col("entry_id") * FAQ_VARIANTS + F.when(F.col("variant") < FAQ_VARIANTS, F.col("variant")).otherwise(F.raise_error(F.lit("too many forms of one question")).cast("int"))
    # every word of a question weighs its share, so that the score is the share itself
    stored = I.sparse_index(index.select(place.alias("id"), F.explode("w").alias("token"), (1 / F.size("w")).alias("weight")))

    def best(form: Column) -> DataFrame:
        own = asked.filter(form.isNotNull()).select("query_id", F.explode(F.array_distinct(words(form))).alias("token"), F.lit(1.0).alias("weight"))
        return I.sparse_index_search(stored, own, 1).select("query_id", F.floor(F.col("id") / FAQ_VARIANTS).cast("long").alias("id"), "score")

    match = V.faq_dual(best(F.col("text")), best(F.when(F.col("rewritten") != F.col("text"), F.col("rewritten"))), threshold)
    wide = match.join(faq.select(F.col("entry_id").alias("match_id"), "question", F.col("answer").alias("faq_answer")), "match_id").join(asked.select("query_id", "text"), "query_id")
    if verify is not None:
        wide = wide.filter(V.accepted(*verify(F.col("text"), F.col("question"))))
    return wide.select("query_id", "match_id", "faq_answer")


def open_facets(chunks: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with facet, the number of their pair of audience and validity; and for each profile (user_role,
    user_semester) the facets it may see (narrow) and those it may see whatever their audience (wide)."""
    pairs = chunks.select(F.col("audience").alias("_a"), F.col("valid").alias("_v")).distinct()
    pairs = scratch(pairs.withColumn("facet", F.row_number().over(Window.orderBy("_a", "_v"))))  # kinds of documents: few
    numbered = chunks.join(F.broadcast(pairs), F.col("audience").eqNullSafe(F.col("_a")) & F.col("valid").eqNullSafe(F.col("_v"))).drop("_a", "_v")
    sees = lambda **how: F.collect_list(F.when(X.visible(F.col("_a"), F.col("_v"), F.col("user_role"), F.col("user_semester"), **how), F.col("facet")))
    both = profiles.select("user_role", "user_semester").distinct().crossJoin(F.broadcast(pairs))  # kinds of readers and of documents
    return numbered, scratch(both.groupBy("user_role", "user_semester").agg(sees().alias("narrow"), sees(with_audience=False).alias("wide")))


def contexts_by_attempt(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, retry, contexts array<struct<rank, id, text>>: what each attempt reads.

    asked: query_id, text, category, user_role, user_semester. Attempts widen: the first sees what the profile may
    see, later ones also what other audiences may, k and the rerank limit grow. The first attempt of a complex query
    reads the merged hits of its parts instead, the eight best of them. All legs are one search of the chunks' postings,
    with the profile's filter inside it, so every attempt can fill its own places.
    """
    s = C.active()
    numbered, profiles = open_facets(chunks, asked)
    numbered = scratch(numbered.withColumn("own", F.array_distinct(words(F.col("text")))))  # each text is split once, not for each hit
    index = I.text_index(numbered.select("id", "text", "facet"), words(F.col("text")))
    own = asked.join(F.broadcast(profiles), ["user_role", "user_semester"])
    hard = F.col("category") == C.INTENTS[1]
    parts = F.filter(F.split("text", "[?？]", -1), lambda p: strip(p) != "")
    of = F.col("query_id").alias("of")
    legs = own.filter(~hard).select(of, F.lit("narrow").alias("leg"), F.lit(0).alias("sub"), "text", F.col("narrow").alias("facets"))
    legs = legs.unionByName(own.select(of, F.lit("wide").alias("leg"), F.lit(0).alias("sub"), "text", F.col("wide").alias("facets")))
    legs = legs.unionByName(own.filter(hard).select(of, F.lit("part").alias("leg"), F.posexplode(parts).alias("sub", "text"), F.col("narrow").alias("facets")))
    legs = scratch(legs.withColumn("query_id", F.monotonically_increasing_id()))
    most = s.top_k * (s.max_retry + 1)
    hits = I.sparse_index_search(index, word_weights(legs, ["query_id", "facets"], F.col("text")), max(most, s.sub_query_k)).join(legs.select("query_id", "of", "leg", "sub"), "query_id")
    hits = scratch(hits.select(F.col("of").alias("query_id"), "leg", "sub", "id", "rank"))
    # a hit is scored once, then goes to every retry that reads it
    first = F.when((F.col("leg") == "narrow") & (F.col("rank") <= s.top_k), F.array(F.lit(0)))
    later = F.when(F.col("leg") == "wide", F.filter(F.sequence(F.lit(1), F.lit(s.max_retry)), lambda i: F.col("rank") <= (i + 1) * s.top_k))
    wide = hits.filter("leg <> 'part'").select("query_id", F.coalesce(first, later, F.array().cast("array<int>")).alias("retries"), "id", "rank", F.lit(s.rerank_k).alias("rerank_k"))
    seen = numbered.select("id", "text")
    merged = V.merged_sub_queries(hits.filter((F.col("leg") == "part") & (F.col("rank") <= s.sub_query_k)).drop("leg").join(seen, "id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("sub", "rank", "id"))
    planned = merged.select("query_id", F.array(F.lit(0)).alias("retries"), "id", place.alias("rank"), F.lit(8).alias("rerank_k"))

    # words meet words and ids are ranked; texts are fetched for those that stay
    questions = asked.select("query_id", F.array_distinct(words(F.col("text"))).alias("question"))
    both = wide.unionByName(planned).filter(F.size("retries") > 0).join(numbered.select("id", "own"), "id").join(questions, "query_id")
    both = both.withColumn("score", F.round(OverlapReranker().share(F.col("question"), F.col("own")), 6))
    both = both.select("query_id", F.explode("retries").alias("retry"), "id", F.col("rank").alias("prior"), "rerank_k", "score")
    both = both.withColumn("rerank_k", F.col("rerank_k") + 2 * F.col("retry"))
    best = V.top_k(both, ["query_id", "retry"], "score", F.col("rerank_k"), ["prior"]).join(seen, "id")
    return best.groupBy("query_id", "retry").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "text"))).alias("contexts"))  # rerank_k of them


def answer(turns: DataFrame, chunks: DataFrame | None = None, faq: DataFrame | None = None, memories: DataFrame | None = None, lexicon: dict | None = None, role: str = C.ROLES[0], semester: str = C.ALWAYS, verify=None) -> DataFrame:
    """The whole turn program over a batch of conversations: one row for each user turn.

    Every turn is classified first; a high one takes the crisis reply and nothing else. The others are routed
    by intent: chit-chat to a fixed reply; the rest to the FAQ (not complex queries), then to retrieval,
    draft and quality gate, with up to max_retry wider attempts, the last one forced. Replies get the care
    suffix of their level; all but crisis and chit-chat leave a memory.

    turns: conv_id, turn, role, text; with user_role and user_semester each turn is filtered by its own reader
    (else by role and semester), with rewritten the FAQ is asked by that form too (faq_hits, also for verify). chunks: id, text, audience, valid. faq: entry_id, question, answer,
    similar_questions, tags. memories: conv_id or, if both they and turns have it, user_id; summary, at (the last three are read). Offline providers
    stand in for services: word overlap reranks and judges, the best context is the draft.

    Returns conv_id, turn, level, source, category, language, route, match_id, contexts (ids), retry_count,
    score, forced, response_source, response, summary, prompt.
    """
    s, key = C.active(), ["conv_id", "turn"]
    spark = turns.sparkSession
    if chunks is None:
        chunks = spark.createDataFrame([], "id long, text string, audience string, valid string")
    if faq is None:
        faq = spark.createDataFrame([], "entry_id long, question string, answer string, similar_questions array<string>, tags array<string>")
    lex = {"high": C.HIGH_RISK, "mid": C.MID_RISK, "negated": C.NEGATED, "weak": C.WEAK_SIGNALS} | (lexicon or {})
    said = F.struct("role", F.col("text").alias("content"))
    before = F.collect_list(said).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * s.history_rounds, -1))
    users = turns.withColumn("history", before).filter("role = 'user'").join(rule_levels(turns, lex["high"], lex["mid"], lex["negated"], lex["weak"]), key)
    model = LexiconClassifier(lex["high"], lex["mid"], lex["weak"])
    r = users.withColumn("e", fused(F.col("level"), model.probabilities(F.col("text"))))
    category = F.when(~F.col("text").rlike(r"\p{L}{2}"), C.INTENTS[3]).when(F.col("text").rlike(any_of((r"\?.*\?", "？.*？"))), C.INTENTS[1]).otherwise(C.INTENTS[0])
    given = lambda name, other: (F.col(name) if name in turns.columns else other).alias(name)
    extra = [given("user_role", F.lit(role)), given("user_semester", F.lit(semester)), given("rewritten", F.col("text")), *(["user_id"] if "user_id" in turns.columns else [])]
    r = r.select(*key, "text", "history", *extra, F.col("e.level").alias("level"), F.col("e.source").alias("source"), F.when(F.col("e.level") != HIGH, category).alias("category"))
    came = F.when(F.col("text").rlike("[\u4e00-\u9fff]"), C.LANGUAGES[0]).otherwise(C.LANGUAGES[1])
    r = session_language(r.withColumn("session", F.col("conv_id")).withColumn("requested", F.lit(None).cast("string")).withColumn("input_language", came)).drop("session", "requested", "input_language")
    r = scratch(r.withColumn("query_id", F.monotonically_increasing_id()))  # read several times below

    asked = r.filter(F.coalesce(F.col("category"), F.lit(C.INTENTS[3])) != C.INTENTS[3]).select("query_id", "text", "rewritten", "category", "user_role", "user_semester")
    found = scratch(faq_hits(asked.filter(F.col("category") != C.INTENTS[1]), faq, verify=verify))
    reads = contexts_by_attempt(asked.join(found, "query_id", "left_anti"), chunks)
    draft = F.get("contexts", 0)["text"]
    judged = reads.join(asked.select("query_id", F.col("text").alias("question")), "query_id").withColumn("score", F.round(OverlapReranker().score(F.col("question"), draft), 6))
    tries = judged.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("retry", F.struct("contexts", "score")))).alias("tries"))
    r = r.join(found, "query_id", "left").join(tries, "query_id", "left").drop("query_id")

    attempt = lambda i: F.try_element_at(F.col("tries"), F.lit(i))
    verdicts = F.array(*[F.struct((F.coalesce(attempt(i)["score"], F.lit(0.0)) >= s.quality_gate).alias("passed"), F.coalesce(attempt(i)["score"], F.lit(0.0)).alias("score")) for i in range(s.max_retry)])
    generates = F.coalesce(F.col("category") != C.INTENTS[3], F.lit(False)) & F.col("match_id").isNull()
    r = r.withColumn("q", F.when(generates, quality(verdicts)))
    last = F.when(F.col("q.forced"), s.max_retry).otherwise(F.col("q.retry_count") - 1)
    none = F.array().cast("array<struct<rank:int,id:bigint,text:string>>")
    read = F.coalesce(F.when(generates, F.try_element_at(F.col("tries"), last)["contexts"]), none)
    r = r.withColumn("last", last).withColumn("read", read).drop("tries")
    r = scratch(r.withColumn("response_source", response_source(F.col("level"), F.col("category"), F.col("match_id"), F.col("read"))))

    where = F.col("response_source")
    plain = F.when(where == "crisis", crisis_reply(F.lit(None).cast("string"))).when(where == "chitchat", reply_in(C.CHITCHAT_TEXT, F.col("language")))
    plain = plain.when(where == "faq", F.col("faq_answer")).when(where == "generated", F.get("read", 0)["text"]).otherwise(reply_in(C.NO_ANSWER_TEXT, F.col("language")))
    reply = F.when(where == "crisis", plain).otherwise(final_response(plain, care_suffix(F.col("level"), F.col("language"))))
    r = r.withColumn("response", reply)
    nodes = F.when(where == "crisis", F.array(after_emotion(F.col("level")), F.lit("care_response"))).when(where == "chitchat", F.array(after_intent(F.col("category")), F.lit("care_suffix"), after_suffix(F.col("category"))))
    nodes = nodes.when(where == "faq", F.array(after_intent(F.col("category")), after_retrieve(F.col("match_id")), after_suffix(F.col("category"))))
    again = F.flatten(F.array_repeat(F.array(F.lit("generate"), F.lit("quality_check"), F.lit("retrieve")), F.col("last")))
    nodes = nodes.otherwise(F.concat(F.array(after_intent(F.col("category"))), again, F.array(F.lit("generate"), F.lit("quality_check"), after_quality(F.lit(True)), after_suffix(F.col("category")))))
    keeps = ~where.isin("crisis", "chitchat")
    recalled = F.array().cast("array<string>")
    if memories is not None:
        whose = "user_id" if "user_id" in memories.columns and "user_id" in turns.columns else "conv_id"
        recent = recent_memories(memories, 3, whose, "at", "summary").groupBy(whose).agg(F.sort_array(F.collect_list(F.struct("rank", "summary"))).alias("m"))
        r, recalled = r.join(recent.select(whose, F.col("m.summary").alias("recalled")), whose, "left"), F.coalesce("recalled", recalled)
    asks = prompt(F.col("text"), F.transform("read", lambda c: c["text"]), F.col("history"), recalled, F.col("language"))
    return r.select(
        *key, "level", "source", "category", "language", F.array_join(nodes, ">").alias("route"), "match_id", F.transform("read", lambda c: c["id"]).alias("contexts"),
        "q.retry_count", F.round("q.score", 6).alias("score"), "q.forced", "response_source", "response",
        F.when(keeps, memory_summary(F.lit(None).cast("string"), F.col("text"), F.col("response"))).alias("summary"), F.when(generates, asks).alias("prompt"),
    )


def evaluation_rows(answers: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """End-to-end rows for judged metrics: row_id, question, answer, contexts (texts), reference; questions:
    conv_id, turn, question, reference."""
    ids = answers.select("conv_id", "turn", "response", F.posexplode_outer("contexts").alias("pos", "id"))
    texts = ids.join(chunks.select("id", "text"), "id", "left").groupBy("conv_id", "turn").agg(F.first("response").alias("answer"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("c"))
    read = F.filter(F.transform("c", lambda x: x["text"]), lambda x: x.isNotNull())
    rows = questions.join(texts, ["conv_id", "turn"])
    return rows.select(F.concat_ws("#", "conv_id", "turn").alias("row_id"), "question", "answer", read.alias("contexts"), "reference")
