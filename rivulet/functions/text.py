"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk id keeps the chunk's number in its last byte.
LAST_CHUNK = 255


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tags_of(value: str | Column) -> Column:
    """A comma-separated string as trimmed tags; none of null or an empty string."""
    v = _col(value)
    return F.when(v.isNull() | (v == ""), F.array().cast("array<string>")).otherwise(F.transform(F.split(v, ","), lambda t: F.trim(t)))


def normal_tag(tag: Column) -> Column:
    """Lower case, without a leading #."""
    return F.regexp_replace(F.lower(F.trim(tag)), "^#", "")


def valid_chunk(text: str | Column) -> Column:
    """Not blank, not a lone code fence, not only marks (neither ASCII word characters nor space), not a heading alone."""
    t = F.trim(F.regexp_replace(_col(text), r"^\s+|\s+$", ""))
    lone_heading = t.rlike(r"^#{1,6}\s+[^\n]+$") & ~t.contains("\n")
    return ~((t == "") | t.isin("```", "~~~") | t.rlike(r"^[^\w\s]+$") | lone_heading)


def chunk_uuid(source: str | Column, index: str | Column | int = 0) -> Column:
    """A deterministic version-4 UUID: 15 bytes of the source's SHA-256, the chunk number as the last."""
    h = F.sha2(_col(source).cast("string"), 256)
    n = F.lit(index) if isinstance(index, int) else _col(index)
    checked = F.when((n < 0) | (n > LAST_CHUNK), F.raise_error(F.concat(F.lit("chunk index must be 0 to 255: "), n.cast("string"))).cast("long")).otherwise(n.cast("long"))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("string"), 10, 16))
    last = F.lower(F.lpad(F.hex(checked), 2, "0"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 10), last)


def add_end_mark(text: str | Column, mark: str | None) -> Column:
    """The text with an end mark; unchanged without one."""
    if mark is not None and not isinstance(mark, str):
        raise TypeError("the end mark must be text")
    return F.concat(_col(text), F.lit(mark)) if mark else _col(text)


def fixed_chunks(text: str | Column, size: int = 200, overlap: int = 50) -> Column:
    """Pieces of ``size`` characters, each beginning size - overlap after the last; tail pieces are kept."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > overlap >= 0")
    t = _col(text)
    starts = F.sequence(F.lit(1), F.length(t), F.lit(size - overlap))
    return F.when(F.length(t) > 0, F.transform(starts, lambda p: t.substr(p, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def word_chunks(text: str | Column, words: int = 5) -> Column:
    """Every ``words`` words, joined by a space."""
    if words <= 0:
        raise ValueError("need words > 0")
    # one scan of the text; inside a function of an array's items a split would run again for each item
    runs = F.regexp_extract_all(_col(text), F.lit(rf"\S+(?:\s+\S+){{0,{words - 1}}}+"), F.lit(0))
    return F.transform(F.coalesce(runs, F.array().cast("array<string>")), lambda run: F.regexp_replace(run, r"\s+", " "))


def exploded(df: DataFrame, items: Column, index: str, value: str) -> DataFrame:
    """One row per item with its position; empty arrays give none."""
    return df.select("*", F.posexplode(items).alias(index, value))


def title_of(path: str | Column) -> Column:
    """The file name without .md, its words capitalised."""
    name = F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"\.md$", "")
    words = F.transform(F.split(name, r"[-_\s]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
    return F.array_join(words, " ")


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def rerank_document(identifier: Column, date: Column, tags: Column, body: Column) -> Column:
    """The text that a reranker sees."""
    shown = F.coalesce(F.when(F.size(tags) >= 0, F.array_join(tags, ", ")), F.lit(""))
    return F.concat(F.lit("Title: "), title_of(identifier), F.lit("\nDate: "), F.coalesce(F.when(date != "", date), F.lit("Unknown")), F.lit("\nTags: "), F.when(shown == "", "None").otherwise(shown), F.lit("\n\nBody:\n"), body)


def instruction(task: str, today: str, query: Column, document: Column) -> tuple[Column, Column]:
    """Query and document with their instruction marks; the date is an argument, so runs agree."""
    return F.concat(F.lit(f"<Instruct>: {task} Current date: {today}\n<Query>: "), query), F.concat(F.lit("<Document>: "), document)


def links_of(html: str | Column, base_url: str | Column) -> Column:
    """Anchors as {target_url, text, is_external}: whole urls as they are, relative ones resolved; empty texts and bad urls are left out.

    Resolution covers the forms that pages use (absolute, //host, /path, relative path, ?query); ``.`` and
    ``..`` segments stay as they are.
    """
    h, base = _col(html), _col(base_url)
    pattern = r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(h, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(h, F.lit(pattern), F.lit(2)).alias("body"))
    scheme, host = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, "://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(://[^/]*)$", "$1/")
    folder = F.regexp_replace(folder, "[^/]*$", "")

    def resolved(href: Column) -> Column:
        return (
            F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(root, href))
            .when(href.startswith("?") | href.startswith("#"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
            .otherwise(F.concat(folder, href))
        )

    def link(pair: Column) -> Column:
        target = resolved(F.trim(pair["href"]))
        text = F.trim(F.regexp_replace(F.regexp_replace(pair["body"], "<[^>]*>", ""), r"\s+", " "))
        return F.struct(target.alias("target_url"), text.alias("text"), (F.lower(F.regexp_extract(target, "://([^/?#]*)", 1)) != F.lower(host)).alias("is_external"))

    return F.filter(F.transform(pairs, link), lambda x: (x["text"] != "") & x["target_url"].rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))


def email_domain(email: str | Column) -> Column:
    domain = F.get(F.split(_col(email), "@"), F.lit(1))
    return F.when(domain.isNull() | (domain == ""), "unknown").otherwise(domain)


def display_name(name: str | Column) -> Column:
    """Each word's first letter in upper case, the rest as it is lower-cased."""
    return F.array_join(F.transform(F.split(_col(name), " "), lambda w: F.concat(F.upper(w.substr(F.lit(1), F.lit(1))), F.lower(w.substr(F.lit(2), F.length(w))))), " ")


def age_group(age: str | Column) -> Column:
    a = _col(age)
    return F.when(a < 30, "young").when(a < 60, "adult").otherwise("senior")


def number_or_zero(text: str | Column) -> Column:
    """The number that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(_col(text), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def size_class(value: str | Column, low: float = 10, high: float = 50) -> Column:
    v = _col(value)
    return F.when(v < low, "low").when(v < high, "medium").otherwise("high")


def token_count(text: str | Column) -> Column:
    """Our default estimate: a token for four characters, rounded up."""
    return F.ceil(F.coalesce(F.length(_col(text)), F.lit(0)) / 4).cast("long")


#: Fixed values of the request estimate: per message, per tool call, per tool, for the reply.
MESSAGE_TOKENS, CALL_TOKENS, TOOL_TOKENS, REPLY_TOKENS = 4, 10, 10, 3


def message_tokens(content: str | Column, name: str | Column | None = None, calls: Column | None = None, count=token_count) -> Column:
    """Tokens of a message row; ``calls`` is an array of {name, arguments}."""
    total = F.lit(MESSAGE_TOKENS) + count(content)
    if name is not None:
        total += F.when(F.coalesce(_col(name), F.lit("")) != "", count(name)).otherwise(0)
    if calls is not None:
        total += F.coalesce(F.aggregate(F.transform(calls, lambda c: count(c["name"]) + count(c["arguments"]) + F.lit(CALL_TOKENS)), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
    return total.cast("long")


def conversation_tokens(messages: DataFrame, by: str, content: str, tools_tokens: int = 0, count=token_count) -> DataFrame:
    """Estimated request size of each conversation."""
    return messages.groupBy(by).agg((F.sum(message_tokens(content, count=count)) + F.lit(REPLY_TOKENS + tools_tokens)).cast("long").alias("estimated_tokens"))


def byte_size(tokens: str | Column) -> Column:
    """Four bytes a token, shown as B, KB (one digit) or MB (two digits)."""
    b = _col(tokens) * 4
    return F.when(b < 1024, F.concat(b.cast("long").cast("string"), F.lit("B"))).when(b < 1024 * 1024, F.format_string("%.1fKB", b / 1024.0)).otherwise(F.format_string("%.2fMB", b / (1024.0 * 1024.0)))


def strip_ansi(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), "\\x1b\\[[0-9;]*m", "")


def shortened(text: str | Column, width: int, mark: str = "...") -> Column:
    t = _col(text)
    cut = F.lit(mark[:width]) if width <= len(mark) else F.concat(t.substr(1, width - len(mark)), F.lit(mark))
    return F.when(F.length(t) <= width, t).otherwise(cut)


def looks_like_vector(size: str | Column) -> Column:
    """Usual embedding dimensions; beyond 100 numbers any array counts."""
    return _col(size).isin(384, 512, 768, 1024, 1536, 3072) | (_col(size) > 100)
