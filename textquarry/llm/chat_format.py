"""Chat formatting by columnar byte assembly.

Turns come in order of conversation and turn. For each Arrow batch the lengths of header, content
and footer segments are summed to offsets, and numpy scatters all their bytes into one preallocated
buffer, which becomes the Arrow column without a string being built for each turn.

Template of a turn: <|turn|>ROLE\n CONTENT <|end|>\n (without the blanks). Inside contents and roles
every control string has a backslash put behind its first character; where one or more
backslashes stand there already, one more is added, so unescape() is exact for all texts.

Defined results
    null text or role: empty. Null conversation id: a conversation of its own. Equal turns (repeated
    rows too) are ordered by role, then text, and all of them kept. Empty table: no rows. Other
    columns are neither read nor returned. A conversation of any length is formatted: it is given
    out in parts, one for each Arrow batch that it touches, numbered from 0.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The strings that would mark turns here or in common templates.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, END = "<|turn|>", "<|end|>\n"

_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_RAW = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])(\\*)\\({_TAILS})")

_DDL = "part int, formatted string, n_turns bigint, loss array<struct<start:bigint,end:bigint>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    return _RAW.sub(r"\1\2\\\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """A role stays on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(segments: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of segments -> bytes of all rows, column after column within a row, and each row's offsets.

    The bytes of a column lie one after another in its source buffer; a segment's bytes go to
    consecutive places from its offset on, so the index of every byte is the segment's offset less its
    place in the source, repeated over its length, plus the place in the source.
    """
    lengths = np.array([[len(s) for s in column] for column in segments], np.int64).reshape(len(segments), -1)
    starts = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths.T.ravel(), out=starts[1:])
    out = np.empty(starts[-1], np.uint8)
    for k, column in enumerate(segments):
        source = np.frombuffer(b"".join(column), np.uint8)
        own = np.cumsum(lengths[k]) - lengths[k]
        out[np.repeat(starts[k : -1 : len(segments)] - own, lengths[k]) + np.arange(len(source))] = source
    return out, starts[:: len(segments)]


def _format_batch(conv: list, roles: list[str], texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, list]:
    """First rows of the conversations, bytes, each conversation's offsets and its loss spans in code points."""
    header = [f"{TURN}{escape_role(r)}\n" for r in roles]
    content = [escape(t) for t in texts]
    out, at = assemble([[h.encode("utf-8", "surrogatepass") for h in header], [c.encode("utf-8", "surrogatepass") for c in content], [END.encode()] * len(texts)])
    first = [k for k in range(len(conv)) if not k or conv[k] != conv[k - 1]]
    loss, place = [], 0
    firsts = set(first)
    for k, (h, c) in enumerate(zip(header, content, strict=True)):
        if k in firsts:
            loss.append([])
            place = 0
        if roles[k] == "assistant":
            loss[-1].append({"start": place + len(h), "end": place + len(h) + len(c)})
        place += len(h) + len(c) + len(END)
    return first, out, at[[*first, len(conv)]], loss


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of conversation, part, formatted, n_turns and loss, the spans (code points within the part) to train on.

    The parts of a conversation follow one another within a partition, in order.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    rows = turns.select(F.col(conv_col).alias(conv_col), F.col(turn_col).alias("__turn"), text[0].alias("__role"), text[1].alias("__text"))
    rows = rows.repartition(conv_col).sortWithinPartitions(conv_col, "__turn", "__role", "__text").drop("__turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_pylist()
            first, out, at, loss = _format_batch(conv, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            parts = [0] * len(first)
            parts[0] = part = part + 1 if conv[0] == last else 0
            if len(first) > 1:
                part = 0
            last = conv[-1]
            formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(out)).cast(pa.string())
            sizes = np.diff([*first, len(conv)])
            cols = [batch.column(0).take(pa.array(first)), pa.array(parts, pa.int32()), formatted, pa.array(sizes, pa.int64()), pa.array(loss, _LOSS)]
            yield pa.RecordBatch.from_arrays(cols, names=[batch.schema.names[0], "part", "formatted", "n_turns", "loss"])

    return rows.mapInArrow(run, f"`{conv_col}` {rows.schema[0].dataType.simpleString()}, {_DDL}")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    turns = formatted.split(TURN)[1:]
    out = []
    for t in turns:
        role, _, text = t.partition("\n")
        out.append((unescape_role(role), unescape(text.removesuffix(END))))
    return out


def digest_parts(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read the parts back: hashes of the turns and of the text under the loss mask, in one pass.

    Directly behind format_conversations(), so that parts are still in order; hashes are carried from
    part to part and memory does not grow with a conversation.
    """
    schema = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, open_id, state, kind = [], None, None, None
        for batch in batches:
            kind, done, ids = batch.schema.field(0), [], []
            names = [batch.schema.names[0], *(n for n, _ in schema)]
            for conv, part, text, loss in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if part == 0:
                    if state:
                        done.append(_close(state))
                        ids.append(open_id)
                    open_id, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                state[0] += len(turns)
                for role, said in turns:
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield _rows(ids, done, kind, names)
        if state:
            yield _rows([open_id], [_close(state)], kind, names)

    def _close(s):
        return s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    def _rows(ids, done, kind, names):
        cols = [pa.array(c, t) for c, (_, t) in zip(zip(*done, strict=True), schema, strict=True)] if done else [pa.array([], t) for _, t in schema]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind.type), *cols], names=names)

    ddl = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return parts.mapInArrow(run, f"`{conv_col}` {parts.schema[0].dataType.simpleString()}, {ddl}")
