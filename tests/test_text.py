import hashlib
import time
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rivulet.functions import display, markdown, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(spark, column_of, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in df.select("i", column_of(F.col("s")).alias("x")).orderBy("i").collect()]


def test_tags(spark):
    assert lit(spark, text.tags_of, "test, sample", "", None) == [["test", "sample"], [], []]


def test_valid_chunks(spark):
    values = ["", "  \n", "```", "~~~", "---", "# Title", "# Title\nbody", "word", "éé", "x."]
    assert lit(spark, text.valid_chunk, *values) == [False] * 6 + [True, True, False, True]
    assert [markdown.is_chunk(v) for v in values] == [False] * 6 + [True, True, False, True]


def test_chunk_uuid(spark):
    got = one(spark, text.chunk_uuid(F.lit("a/b.md"), 7))
    raw = bytearray(hashlib.sha256(b"a/b.md").digest()[:16])
    raw[6], raw[8], raw[15] = raw[6] & 0x0F | 0x40, raw[8] & 0x3F | 0x80, 7
    assert got == str(uuid.UUID(bytes=bytes(raw))) and uuid.UUID(got).version == 4
    for bad in (-1, 256):
        with pytest.raises(Exception, match="chunk index"):
            one(spark, text.chunk_uuid(F.lit("a"), bad))


def test_chunkers(spark):
    s = "".join(chr(97 + i % 26) for i in range(400))
    assert one(spark, text.fixed_chunks(F.lit(s))) == [s[0:200], s[150:350], s[300:400]]
    assert one(spark, text.fixed_chunks(F.lit(""))) == []
    assert one(spark, text.word_chunks(F.lit("a b  c d e f"))) == ["a b c d e", "f"]
    with pytest.raises(ValueError):
        text.fixed_chunks("x", 10, 10)


def test_titles_and_names(spark):
    assert lit(spark, text.title_of, "x/my-first_note two.md", "plain") == ["My First Note Two", "Plain"]
    assert lit(spark, text.email_domain, "a@b.c", "nothing", None) == ["b.c", "unknown", "unknown"]
    assert lit(spark, text.display_name, "ada LOVELACE") == ["Ada Lovelace"]
    assert lit(spark, text.number_or_zero, "5.5", "x", "12abc", None) == [5.5, 0.0, 12.0, 0.0]


def test_lines_to_classes(spark):
    df = spark.createDataFrame([("5.5\n12.3\n67.8\n0.0\n34.2\n100.5",)], "s string").select(F.explode(F.split("s", "\n")).alias("s"))
    df = df.withColumn("n", text.number_or_zero("s")).where("n > 0").withColumn("c", text.size_class("n"))
    assert {r["c"]: r["count"] for r in df.groupBy("c").count().collect()} == {"low": 1, "medium": 2, "high": 2}


def test_links(spark):
    html = '<a href="/x">One</a> <a class="b" href="https://other.org/p">Two <b>bold</b></a> <a href="y?z=1">Three</a><a href="/q"> </a><a href="//cdn.net/f">Four</a>'
    got = one(spark, text.links_of(F.lit(html), F.lit("https://site.com/a/b?c=d#e")))
    assert [tuple(x) for x in got] == [("https://site.com/x", "One", False), ("https://other.org/p", "Two bold", True), ("https://site.com/a/y?z=1", "Three", False), ("https://cdn.net/f", "Four", True)]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "abcd"), (1, "abcde"), (2, None)], "c int, t string")
    got = {r["c"]: r["estimated_tokens"] for r in text.conversation_tokens(df, "c", "t").collect()}
    assert got == {1: 4 + 1 + 4 + 2 + 3, 2: 7}
    assert [one(spark, text.byte_size(F.lit(n))) for n in (10, 512, 400_000)] == ["40B", "2.0KB", "1.53MB"]


def test_end_marks(spark):
    assert one(spark, text.add_end_mark(F.lit("a"), "<e>")) == "a<e>"
    assert one(spark, text.add_end_mark(F.lit("a"), None)) == "a"
    with pytest.raises(TypeError):
        text.add_end_mark("a", 3)


def test_rerank_document(spark):
    got = one(spark, text.rerank_document(F.lit("d/a-note.md"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit("body")))
    assert got == "Title: A Note\nDate: Unknown\nTags: None\n\nBody:\nbody"


def test_front_matter():
    data, rest = markdown.front_matter("---\ntags: test, sample\ntitle: \"A: b\"\nlist:\n  - x\n  - y\nflow: [p, q]\n---\nbody\n")
    assert data == {"tags": "test, sample", "title": "A: b", "list": ["x", "y"], "flow": ["p", "q"]} and rest == "body\n"
    assert markdown.front_matter("no --- here") == ({}, "no --- here")
    assert markdown.parse_tags(None) == [] == markdown.parse_tags("") and markdown.parse_tags(["a"]) == ["a"]


def test_cleaning():
    source = "---\ntags: [a, b]\n---\n# Keep\n\n**bold** and *it* and ~~gone~~ `**code**` [l*i*nk](http://x/_y_)\n\n## Task\n\ndrop\n\n### Deeper\n\ndrop too\n\n## After\n\nsnake_case_word\n\n```\n## Task\n**raw**\n```\n"
    content, tags, _ = markdown.clean(source)
    assert tags == ["a", "b"]
    assert "drop" not in content and "## After" in content
    assert "bold and it and gone `**code**` [link](http://x/_y_)" in content
    assert "snake_case_word" in content and "## Task\n**raw**" in content


def test_splitting():
    assert markdown.split_chunks("   ") == []
    pieces = markdown.split_chunks("# A\n\n" + "word " * 500 + "\n\n# B\n\nshort", 300, 30)
    assert all(len(p) <= 600 for p in pieces) and pieces[-1].endswith("short")
    assert " ".join(pieces).count("word") >= 500


def test_letters_are_cut_by_slices():
    for text, size, overlap in (("0123456789", 4, 1), ("abc", 4, 1), ("ab cd efg", 3, 5), ("   x", 2, 0), ("", 3, 1)):
        step = size - min(overlap, size - 1)
        want = [text[p : p + size].strip() for p in range(0, max(len(text) - size, 0) + step, step)]
        assert markdown.recursive_split(text, size, overlap, ("",)) == [w for w in want if w]
    began = time.perf_counter()
    assert len(markdown.recursive_split("x" * 10_000_000, 1000, 100, ("",))) == 11_111
    assert time.perf_counter() - began < 1


def test_words_of_a_long_text_are_split_once(spark):
    """For each chunk anew, this would take minutes."""
    df = spark.createDataFrame([(" ".join(map(str, range(100_001))) + " \t",), (None,), (" \n",)], "t string").select(text.word_chunks("t").alias("c"))
    began = time.perf_counter()
    got = [r["c"] for r in df.collect()]
    assert time.perf_counter() - began < 20 and got[1:] == [[], []]
    assert len(got[0]) == 20_001 and got[0][-1] == "100000" and got[0][1] == "5 6 7 8 9"


def test_document_flow(spark):
    df = spark.createDataFrame([("a.md", "---\ntags: x\n---\n# T\n\nhello **world**"), ("b.md", None), ("c.md", "")], "source string, page string")
    cleaned = markdown.clean_documents(df, "page")
    assert [r["source"] for r in cleaned.orderBy("source").collect()] == ["a.md", "c.md"]
    chunks = markdown.split_documents(cleaned.select("source", "content", "tags"), "content", "source").collect()
    assert [(c["source"], c["chunk_idx"], c["tags"]) for c in chunks] == [("a.md", 0, ["x"])] and "hello world" in chunks[0]["chunk"]


def test_display():
    assert [display.number(n) for n in (500, 2500, 1_500_000, 2e9, -2500)] == ["500", "2.5K", "1.5M", "2.0B", "-2.5K"]
    assert [display.duration(n) for n in (500, 2500, 90_000, 3_700_000, -1)] == ["500ms", "2.5s", "1m 30s", "1h 1m", "0ms"]
    assert [display.rate(r) for r in (0, 0.5, 50, 2500)] == ["0/s", "30.0/min", "50.0/s", "2.5K/s"]
    assert display.eta(0) == "done" and display.eta(float("inf")) == "calculating..." and display.eta(500) == "ETA 500ms"
    assert display.truncate("abcdef", 5) == "ab..." and display.truncate("abcdef", 2) == ".." and display.visible("\x1b[31mx\x1b[0m") == "x"


def test_sanitising():
    assert display.sanitized("x" * 501).endswith("... [truncated: 501 chars total]")
    assert display.sanitized([0.5] * 384) == "[Embedding: dim=384, sample=[0.500, 0.500, 0.500, ...]]"
    assert display.sanitized({"a": {"b": {"c": {"d": 1}}}}) == {"a": {"b": {"c": {"__keys__": ["d"], "__depth__": "max depth exceeded"}}}}
    assert display.sanitized({"id": "x" * 600, "payload": {"k": 1}, "n": [1, 2, 3, 4]}) == {"id": "x" * 600, "payload": {"__keys__": ["k"]}, "n": {"__arrayInfo__": {"length": 4, "showing": 3, "items": [1, 2, 3]}}}
    assert display.sanitized(datetime(2024, 1, 2)) == "2024-01-02T00:00:00"
