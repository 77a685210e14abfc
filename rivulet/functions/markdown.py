"""Markdown: front matter, cleaning, splitting.

These rules are sequential inside a text, so they run as plain functions over
Arrow batches; each text is handled on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headings whose sections are removed unless others are named.
REMOVED_SECTIONS = ("Project List", "Due Today", "Todoist Tasks", "Daily Reading", "Completed Today", "Habit", "Jira Tickets", "Task", "Bullet", "File")

_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|\Z)", re.S | re.M)
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def front_matter(text: str) -> tuple[dict, str]:
    """(data, content).  A YAML subset: ``key: value``, ``[a, b]`` and dashed lists of scalars."""
    m = _FRONT.match(text)
    if not m:
        return {}, text
    data: dict = {}
    key = None
    for line in m[1].splitlines():
        item = re.match(r"^\s*-\s+(.*)$", line)
        pair = re.match(r"^([A-Za-z0-9_][\w .-]*):(?:\s+(.*))?$", line)
        if item and key is not None:
            if not isinstance(data[key], list):
                data[key] = []
            data[key].append(_scalar(item[1]))
        elif pair:
            key, value = pair[1].strip(), (pair[2] or "").strip()
            listed = re.match(r"^\[(.*)\]$", value)
            data[key] = [_scalar(v) for v in listed[1].split(",") if v.strip()] if listed else _scalar(value)
    return data, text[m.end() :]


def _scalar(value: str):
    value = value.strip()
    quoted = re.match(r"""^(["'])(.*)\1$""", value)
    return quoted[2] if quoted else value


def parse_tags(value) -> list[str]:
    """A string split at commas, a list as it is, anything else none."""
    if isinstance(value, list):
        return [str(v) for v in value]
    return [t.strip() for t in value.split(",")] if isinstance(value, str) and value else []


def _lines(text: str) -> Iterator[tuple[str, bool]]:
    """Lines, and whether each is outside code fences."""
    fence = None
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence is None and m:
            fence = m[1][0] * 3
            yield line, False
        elif fence is not None:
            if m and m[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = None
            yield line, False
        else:
            yield line, True


def remove_sections(text: str, titles: Sequence[str] = REMOVED_SECTIONS) -> str:
    """Without the named headings and all up to the next heading of the same or a higher level."""
    kept, under = [], 0
    for line, plain in _lines(text):
        m = _HEADING.match(line) if plain else None
        if m:
            level = len(m[1])
            if under and level <= under:
                under = 0
            if not under and (m[2] or "").strip() in titles:
                under = level
        if not under:
            kept.append(line)
    return "\n".join(kept)


_EMPHASIS = [
    (re.compile(r"(?<!\\)(\*\*\*|___)(?=\S)(.+?)(?<=\S)\1"), r"\2"),
    (re.compile(r"(?<!\\)\*\*(?=\S)(.+?)(?<=\S)\*\*"), r"\1"),
    (re.compile(r"(?<![\\\w])__(?=\S)(.+?)(?<=\S)__(?!\w)"), r"\1"),
    (re.compile(r"(?<!\\)~~(?=\S)(.+?)(?<=\S)~~"), r"\1"),
    (re.compile(r"(?<![\\*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?!\*)"), r"\1"),
    (re.compile(r"(?<![\\\w])_(?=\S)(.+?)(?<=\S)_(?!\w)"), r"\1"),
]
_CODE_OR_LINK = re.compile(r"(`+[^`\n]*`+|\]\([^)\s]*\)|<[^>\s]+>)")


def plain_inline(text: str) -> str:
    """Emphasis, strong and strikethrough unwrapped; code, link targets and fenced blocks stay."""
    out = []
    for line, plain in _lines(text):
        if plain and not re.match(r"^ {0,3}([-*_])( *\1){2,} *$", line):
            held: list[str] = []

            def hold(m: re.Match) -> str:
                held.append(m[0])
                return f"\x00{len(held) - 1}\x00"

            line = _CODE_OR_LINK.sub(hold, line)
            for pattern, to in _EMPHASIS:
                line = pattern.sub(to, line)
            line = re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], line)
        out.append(line)
    return "\n".join(out)


def clean(text: str, titles: Sequence[str] = REMOVED_SECTIONS) -> tuple[str, list[str], dict]:
    """(content, tags, front matter)."""
    data, content = front_matter(text)
    content = plain_inline(remove_sections(content, titles))
    content = re.sub(r"\n{3,}", "\n\n", content).strip("\n")
    return content, parse_tags(data.get("tags")), data


# Our own choice of separators, from coarse to fine.
MARKDOWN_SEPARATORS = ("\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n", "\n***\n", "\n---\n", "\n___\n", "\n\n", "\n", " ", "")
TEXT_SEPARATORS = ("\n\n", "\n", " ", "")


def _letters(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of ``size`` characters, each beginning with the last ``overlap`` of the one before; blank ones left out."""
    size = max(size, 1)
    step = size - min(max(overlap, 0), size - 1)
    last = max(len(text) - size, 0)
    pieces = (text[p : p + size].strip() for p in range(0, last + step, step))
    return [p for p in pieces if p]


def recursive_split(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separators that allow it and merged with ``overlap``."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[list(separators).index(sep) + 1 :] if sep in separators else ()
    if sep == "":
        return _letters(text, size, overlap)
    head, *rest = text.split(sep)
    parts = [p for p in (head, *(sep + r for r in rest)) if p]
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        piece = "".join(run).strip()
        if piece:
            out.append(piece)

    length = 0
    for part in parts:
        if len(part) > size and finer:
            flush()
            run.clear()
            length = 0
            out += recursive_split(part, size, overlap, finer)
            continue
        if length + len(part) > size and run:
            flush()
            while run and (length > overlap or length + len(part) > size):
                length -= len(run.pop(0))
        run.append(part)
        length += len(part)
    flush()
    return out


def smart_split(text: str, most: int = 1000, overlap: int = 100) -> list[str]:
    """Markdown-aware pieces of up to twice ``most``; those beyond ``most`` are cut again, with overlap."""
    out: list[str] = []
    for piece in recursive_split(text, 2 * most, 0, MARKDOWN_SEPARATORS):
        out += recursive_split(piece, most, overlap, TEXT_SEPARATORS) if len(piece) > most else [piece]
    return out


def is_chunk(text: str) -> bool:
    t = text.strip()
    return bool(t) and t not in ("```", "~~~") and not re.fullmatch(r"[^\w\s]+", t, re.A) and not ("\n" not in t and re.match(r"^#{1,6}\s+.+$", t))


def split_chunks(text: str, most: int = 1000, overlap: int = 100) -> list[str]:
    """Valid pieces of a text; blank texts have none."""
    return [p for p in smart_split(text, most, overlap) if is_chunk(p)] if text.strip() else []


def clean_documents(df: DataFrame, text: str, titles: Sequence[str] = REMOVED_SECTIONS) -> DataFrame:
    """``df`` with content, tags and frontmatter (a map of strings); texts that can't be read are dropped."""

    def run(batches):
        for batch in batches:
            content, tags, data, good = [], [], [], []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                try:
                    c, g, d = clean(t, titles)
                    good.append(True)
                except (TypeError, ValueError, AttributeError):
                    good.append(False)
                    continue
                content.append(c)
                tags.append(g)
                data.append([(k, v if isinstance(v, str) else ",".join(map(str, v))) for k, v in d.items()])
            kept = batch.filter(pa.array(good, pa.bool_()))
            kept = kept.append_column("content", pa.array(content, pa.string())).append_column("tags", pa.array(tags, pa.list_(pa.string())))
            yield kept.append_column("frontmatter", pa.array(data, pa.map_(pa.string(), pa.string())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, content string, tags array<string>, frontmatter map<string,string>")


def split_documents(df: DataFrame, content: str, source: str, most: int = 1000, overlap: int = 100) -> DataFrame:
    """One row per valid chunk: the row's columns, chunk_idx from 0, chunk, length and a deterministic id.

    More than 256 chunks of a source are an error, as ids keep the number in a byte.
    """
    from .text import chunk_uuid

    kept = [f for f in df.schema.fields if f.name != content]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(content)
            pieces = [split_chunks(t or "", most, overlap) for t in batch.column(at).to_pylist()]
            row = pa.array([i for i, p in enumerate(pieces) for _ in p], pa.int64())
            out = batch.remove_column(at).take(row)
            out = out.append_column("chunk_idx", pa.array([k for p in pieces for k in range(len(p))], pa.int64()))
            yield out.append_column("chunk", pa.array([c for p in pieces for c in p], pa.string()))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    out = df.mapInArrow(run, f"{fields}chunk_idx bigint, chunk string")
    return out.select("*", F.length("chunk").cast("long").alias("length"), chunk_uuid(source, "chunk_idx").alias("chunk_id"))
