"""Chat formatting at the level of tokens.

Every turn is encoded on its own: role and text are separate segments, and the
reserved ids TURN, BODY and END are spliced between them, so no text can ever
encode to a reserved id.  In the formatted text the same marks are the strings
MARKS; these and other models' control strings are escaped in roles and texts by
an escape character after their first character (and escape characters
are doubled), which is reversible.  The loss mask comes from prefix sums over +1 where an
assistant text begins and -1 where it ends.

Encoding runs on all rows wherever they lie; only then turns go to their conversation,
sorted, and are assembled as they stream by.  Memory is one conversation's
tokens, which are one output row.

Defined results: turns are in order of ``turn`` (null first), then of role and
text tokens, and repeated rows are repeated turns; null texts and roles are
empty; rows with a null conversation id are one conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public pre-tokenizer pattern of this vocabulary, and the ids it leaves free.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
TURN, BODY, END = 50_257, 50_258, 50_259
MARKS = {TURN: "<|turn|>", BODY: "<|body|>", END: "<|end|>"}
# Control strings of public chat templates.
CONTROL = (*MARKS.values(), "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"
LEARNED_ROLE = "assistant"

_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")
_encodings: dict[str, object] = {}


def escape(text: str) -> str:
    return _STARTS.sub(rf"\1{ESCAPE}", text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content; made once a process."""
    import tiktoken

    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _encodings[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def load_vocabulary(path: str = VOCABULARY) -> bytes:
    """Read once on the driver; executors get the content (about a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def format_chat(turns: DataFrame, vocabulary: bytes, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, n_turns, input_ids, loss_mask (0 or 1 per id), formatted (text)."""
    sent = turns.sparkSession.sparkContext.broadcast(vocabulary)
    kind = turns.schema[conv_col].dataType.simpleString()

    def encode(batches):
        for batch in batches:
            encoder = encoding(sent.value)
            columns = []
            for c in (2, 3):
                texts = [escape(t) if t else "" for t in batch.column(c).to_pylist()]
                columns.append(pa.array([np.array(ids, np.int32).tobytes() for ids in encoder.encode_ordinary_batch(texts, num_threads=1)], pa.binary()))
            learned = pa.array([r == LEARNED_ROLE for r in batch.column(2).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, learned], ["conv", "turn", "role_ids", "text_ids", "learned"])

    def assemble(batches):
        now, count, parts = None, 0, []

        def row():
            ids = np.concatenate([p for p, _ in parts])
            change = np.zeros(len(ids) + 1, dtype=np.int8)
            at = 0
            for p, learned in parts:
                if learned:
                    change[at] += 1
                    change[at + len(p)] -= 1
                at += len(p)
            mask = np.cumsum(change[:-1], dtype=np.int8)
            return now, count, ids, mask, to_text(ids, encoding(sent.value))

        for batch in batches:
            done = []
            for conv, _, role, text, learned in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and conv != now:
                    done.append(row())
                    count, parts = 0, []
                now = conv
                count += 1
                mark = [np.array([m], np.int32) for m in (TURN, BODY, END)]
                parts += [(mark[0], False), (np.frombuffer(role, np.int32), False), (mark[1], False), (np.frombuffer(text, np.int32), learned), (mark[2], False)]
            if done:
                yield _chat_batch(done, batch.schema.field(0).type)
            kind_of = batch.schema.field(0).type
        if parts:
            yield _chat_batch([row()], kind_of)

    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    encoded = rows.mapInArrow(encode, f"conv {kind}, turn bigint, role_ids binary, text_ids binary, learned boolean")
    placed = encoded.repartition("conv").sortWithinPartitions("conv", "turn", "role_ids", "text_ids")
    return placed.mapInArrow(assemble, f"{conv_col} {kind}, n_turns bigint, input_ids array<int>, loss_mask array<tinyint>, formatted string")


def _chat_batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    conv, count, ids, mask, text = zip(*rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(count, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(mask))), pa.array(text, pa.string())], ["conv_id", "n_turns", "input_ids", "loss_mask", "formatted"])


def _segments(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(mark, first place after it, place of the next mark) in order."""
    at = np.flatnonzero(ids >= TURN).tolist()
    return [(int(ids[a]), a + 1, b) for a, b in zip(at, [*at[1:], len(ids)])]


def _decoded(ids: np.ndarray, encoder) -> str:
    return encoder.decode_bytes(ids.tolist()).decode("utf-8")


def to_text(ids: np.ndarray, encoder) -> str:
    return "".join(MARKS[mark] + _decoded(ids[a:b], encoder) for mark, a, b in _segments(ids))


def _said(ids: np.ndarray, encoder) -> dict[tuple[int, int], str]:
    """The text of each segment, by its place; each is decoded once."""
    return {(a, b): unescape(_decoded(ids[a:b], encoder)) for _, a, b in _segments(ids)}


def read_turns(ids: np.ndarray, encoder, said: dict[tuple[int, int], str] | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn, from token ids alone."""
    said = _said(ids, encoder) if said is None else said
    parts = [(mark, said[a, b]) for mark, a, b in _segments(ids)]
    return [(role, text) for (mark, role), (_, text) in zip(parts, parts[1:]) if mark == TURN]


def learned_texts(ids: np.ndarray, mask: np.ndarray, encoder, said: dict[tuple[int, int], str] | None = None) -> list[str]:
    """The texts under the loss mask, from ids and mask alone; ``said`` has those already decoded."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).tolist()
    said = said or {}
    return [said[a, b] if (a, b) in said else unescape(_decoded(ids[a:b], encoder)) for a, b in zip(edge[::2], edge[1::2])]


def digests(chats: DataFrame, vocabulary: bytes, conv_col: str = "conv_id") -> DataFrame:
    """What the output of format_chat() says when it is read back, as digests."""
    sent = chats.sparkSession.sparkContext.broadcast(vocabulary)
    kind = chats.schema[conv_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            encoder = encoding(sent.value)
            out: tuple = ([], [], [], [], [])
            for i in range(batch.num_rows):
                ids, mask = (np.asarray(batch.column(c)[i].values) for c in (1, 2))
                said = _said(ids, encoder)
                turns = read_turns(ids, encoder, said)
                whole, learned = hashlib.sha256(), hashlib.sha256()
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                texts = learned_texts(ids, mask, encoder, said)
                for text in texts:
                    learned.update(text.encode())
                for o, v in zip(out, (len(turns), whole.hexdigest(), sum(map(len, texts)), learned.hexdigest(), len(batch.column(3)[i].as_py()))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select(conv_col, "input_ids", "loss_mask", "formatted").mapInArrow(run, f"{conv_col} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
