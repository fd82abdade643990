"""Text column functions: Column in, Column out, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def let(c: Column, body) -> Column:
    """body of a value computed once: inside a lambda a plain expression would run for every element."""
    return F.get(F.transform(F.array(c), body), 0)


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column, noise: tuple[str, ...] = C.NOISE_LINES, counters: str = C.COUNTERS) -> Column:
    """Drop counters and invisible characters, strip lines, drop noise lines, then squeeze blank runs."""
    text = F.regexp_replace(F.regexp_replace(c, "(?U)" + counters, ""), C.INVISIBLE, "")
    lines = F.transform(F.split(text, "\n", -1), strip)
    if noise:
        lines = F.filter(lines, lambda x: ~x.rlike("(?U)" + "|".join(f"(?:{p})" for p in noise)))
    # a blank line stays only behind a line that is not blank
    joined = let(lines, lambda ls: F.array_join(F.filter(ls, lambda x, i: (x != "") | ((i > 0) & (F.get(ls, i - 1) != ""))), "\n"))
    return F.regexp_replace(joined, r"^\n+|\n+$", "")


def normalise(c: Column) -> Column:
    """Remove all white space."""
    return F.regexp_replace(c, r"(?U)[\s　]+", "")


def locate_span(haystack: Column, needle: Column) -> Column:
    """The needle if contained, else the verbatim slice that equals it without white space, else null."""
    bare = normalise(needle)
    quoted = F.transform(F.split(bare, ""), lambda ch: F.concat(F.lit("\\Q"), ch, F.lit("\\E")))
    pattern = F.array_join(F.filter(quoted, lambda q: q != "\\Q\\E"), r"\s*")
    loose = F.when(F.contains(normalise(haystack), bare), F.nullif(F.regexp_substr(haystack, F.concat(F.lit("(?U)"), pattern)), F.lit("")))
    return F.when(bare == "", F.lit(None)).when(F.contains(haystack, needle), needle).otherwise(loose)


def located(haystack: Column, needle: Column) -> Column:
    """Whether locate_span finds the needle."""
    bare = normalise(needle)
    return (bare != "") & (F.contains(haystack, needle) | F.contains(normalise(haystack), bare))


def title_from_name(c: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(c, C.INVISIBLE, ""), r"(?<=.)\.[^.]*$", "")
    stem = F.regexp_replace(stem, "_[0-9a-f]{8}$", "")
    return F.regexp_replace(stem, rf"(?i)(?<=.)\.({'|'.join(C.EXTENSIONS)})$", "")


def safe_filename(title: Column, fallback: Column) -> Column:
    t = strip(F.regexp_replace(F.regexp_replace(title, C.INVISIBLE, ""), C.ILLEGAL_NAME, ""))
    t = strip(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), C.SUFFIX_RE, ""))
    return F.coalesce(F.nullif(F.left(t, F.lit(60)), F.lit("")), fallback)


def strip_title_prefix(c: Column) -> Column:
    return F.regexp_replace(c, C.TITLE_PREFIX, "")


def publish_date(c: Column, fallback: Column) -> Column:
    """First 20yy-m-d in the text as text, padded but not validated."""
    pattern = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
    part = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
    found = F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0"))
    return F.when(part[0] != "", found).otherwise(fallback)


def url_hash(c: Column) -> Column:
    return F.md5(c)


def relative_path(c: Column, base: str) -> Column:
    """The path below base; the whole path, with forward slashes, where it lies elsewhere."""
    path, base = F.replace(c, F.lit("\\"), F.lit("/")), base.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, F.length(path))).otherwise(path)


def mask_pii(c: Column) -> Column:
    """Phone numbers first, then ids of 8 to 11 digits."""
    return F.regexp_replace(F.regexp_replace(c, C.PHONE_RE, C.PHONE_TOKEN), C.ID_RE, C.ID_TOKEN)


def sanitize(c: Column, limit: int | None = None) -> Column:
    """Mask, then truncate."""
    return mask_pii(c) if limit is None else F.left(mask_pii(c), F.lit(limit))


def sanitize_all(c: Column, depth: int = 1) -> Column:
    """Mask every text of an array, or of arrays in arrays down to depth; null stays null."""
    return F.transform(c, mask_pii if depth == 1 else lambda x: sanitize_all(x, depth - 1))


def tail(c: Column, n: int) -> Column:
    """Last n elements of an array, all of a shorter one."""
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)


@C.configured
def minimised_context(messages: Column, keep: int = C.setting("context_messages")) -> Column:
    """Last messages with masked content."""
    return F.transform(tail(messages, keep), lambda m: F.struct(m["role"].alias("role"), mask_pii(m["content"]).alias("content")))


def json_object(c: Column) -> Column:
    """The whole text as a JSON object, else what stands from its first { to its last }; else null."""
    whole = F.try_parse_json(c)
    inner = F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def qa_clean(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, "(?U)" + C.QA_MARK, ""), "(?U)" + C.NOTE_AT_START, "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s*\n\s*", " "), r"(?U)\s{2,}", " ")
    t = F.regexp_replace(t, r"^[ 　\-—]+|[ 　\-—]+$", "")
    return strip(F.regexp_replace(t, "(?U)" + C.NUMBER_AT_END, ""))


@C.configured
def strip_residue(c: Column, least: int = C.setting("answer_chars", part=0)) -> Column:
    """Drop a section title or page controls at the end, twice at most, never below the least length."""

    def shorter(x: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(x, "(?U)" + C.SECTION_AT_END, ""), "(?U)" + C.UI_AT_END, ""))

    def again(p: Column) -> Column:
        return let(shorter(p["out"]), lambda y: F.when(p["going"] & (F.length(y) >= least), y).otherwise(p["out"]))

    once = let(c, lambda x: let(shorter(x), lambda y: F.struct(F.when(F.length(y) >= least, y).otherwise(x).alias("out"), (F.length(y) >= least).alias("going"))))
    return let(once, again)


@C.configured
def strip_leading_question(c: Column, least: int = C.setting("answer_chars", part=0)) -> Column:
    shorter = lambda x: strip(F.regexp_replace(x, "(?U)" + C.QUESTION_AT_START, ""))
    return let(c, lambda x: let(shorter(x), lambda y: F.when(F.length(y) >= least, y).otherwise(x)))


def fix_broken_tokens(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, C.BROKEN_LETTER, "$1"), C.BROKEN_DIGIT, "")


def valid_pair(q: Column, a: Column, s: C.Settings | None = None) -> Column:
    s = s or C.active()
    urls_out = strip(F.regexp_replace(a, r"https?://\S+", ""))
    ends = strip(q).endswith("？") | strip(q).endswith("?")
    return F.length(q).between(*s.question_chars) & F.length(a).between(*s.answer_chars) & ends & (F.length(urls_out) >= s.answer_chars[0])


def dedup_key(c: Column) -> Column:
    """Only letters, digits and underscores of any script."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "")


def near_dup_form(c: Column) -> Column:
    return F.lower(dedup_key(c))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams; none for shorter texts."""

    def grams(chars: Column) -> Column:
        last = F.size(chars) - n + 1
        at = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])))

    return let(F.filter(F.split(c, ""), lambda ch: ch != ""), grams)


def semester(d: Column, autumn: str = "秋季", spring: str = "春季", summer: str = "暑期") -> Column:
    y, m = F.year(d), F.month(d)
    first = F.when(m >= 9, y).otherwise(y - 1)
    name = F.when((m >= 9) | (m == 1), F.lit(autumn)).when(m <= 6, F.lit(spring)).otherwise(F.lit(summer))
    return F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string"), name)


def effective_semester(policy: Column, date_text: Column) -> Column:
    at = F.try_to_timestamp(date_text, F.lit("yyyy-MM-dd"))
    return F.when(policy != "发布学期", policy).otherwise(F.coalesce(semester(at), F.lit(C.ALWAYS)))


def visible(audience: Column, valid: Column, role: Column, current: Column, with_audience: bool = True) -> Column:
    """Roles outside the three known ones see only what is for everyone."""
    ok = valid.isin(C.ALWAYS) | (valid == current)
    return ok if not with_audience else ok & ((audience == C.EVERYONE) | (role.isin(*C.ROLES) & (audience == role)))


def letter_share(c: Column, letters: str = "[\u4e00-\u9fff]") -> Column:
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.regexp_replace(c, letters, ""))) / F.length(c)).otherwise(F.lit(0.0))


def usable_chunk(c: Column, letters: str = "[\u4e00-\u9fff]", s: C.Settings | None = None) -> Column:
    s = s or C.active()
    return (F.length(c) >= s.usable_chars) & (letter_share(c, letters) >= s.usable_share)


@C.configured
def sample_length(c: Column, chars: tuple = C.setting("sample_chars")) -> Column:
    """Whether a sample's length is allowed."""
    return F.length(c).between(*chars)


def is_detail_page(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "").rlike(r"page\.htm$")


def is_attachment(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "").rlike(C.SUFFIX_RE)
