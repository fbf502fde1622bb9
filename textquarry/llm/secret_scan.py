"""Secret scanning over a trigram inverted index.

For each rule a Boolean query of trigrams is derived from its regular expression: trigrams that every
match must contain, joined by AND along a sequence and by OR over alternatives. For every block of
documents an inverted index of the trigrams in use is built (trigram -> documents, as bit rows); rules
intersect and unite postings, and only the candidates are searched with the expression itself. A rule
without mandatory trigrams searches every document. The index only rules documents out, so the spans
are those of the expressions over all whole texts.

The index folds A-Z to a-z and works on UTF-8 bytes; expressions run on the text, so spans are code
points, end exclusive.

Defined results
    null or empty text: no spans. Null or repeated ids: each row is scanned and returned. Two rules
    may report the same place; spans are ordered by start, then by the order of the rules. Empty table:
    no rows. Other columns are neither read nor returned. Memory is bounded by a block of texts;
    a longer text is indexed in chunks and searched whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _parser as sre  # the parsed form of an expression

#: Query nodes: ALL, ("and", parts), ("or", parts) or a trigram as bytes.
ALL = "all"
#: Sets of exact strings larger than this are not carried on.
_MOST_STRINGS = 64
_CLASS_LIMIT = 8
_CHUNK = 2 << 20


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose `group` has under `least` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds and patterns of the base rules, then the further token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("messaging", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[^\s/@:]+@"),
)


# ---- trigram queries -------------------------------------------------------------------------------


def _all_of(parts: list):
    parts = [p for p in parts if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any_of(parts: list):
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]):
    """What holds if one of the strings occurs."""
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _fold(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass").lower()


def _class(items: list) -> set[bytes] | None:
    """The folded strings of a character class, or None if they are many or open-ended."""
    out: set[bytes] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(_fold(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 2 * _CLASS_LIMIT:
            out |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= _CLASS_LIMIT else None


def _cross(a: set[bytes], b: set[bytes]) -> set[bytes] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= _MOST_STRINGS else None


def _walk(nodes) -> tuple[set[bytes] | None, object]:
    """(all strings the nodes can match, or None; a query that every match satisfies)."""
    run, parts, exact = {b""}, [], True

    def close(start: set[bytes] | None = None) -> None:
        nonlocal run, exact
        parts.append(_of_strings(run))
        run, exact = start or {b""}, False

    for op, arg in nodes:
        own, query, more = None, ALL, False
        if op is sre.LITERAL:
            own = {_fold(arg)}
        elif op is sre.IN:
            own = _class(arg)
        elif op is sre.SUBPATTERN:
            own, query = _walk(arg[-1])
        elif op is sre.BRANCH:
            sides = [_walk(x) for x in arg[1]]
            own = set().union(*(x or () for x, _ in sides)) if all(x is not None for x, _ in sides) else None
            query = _any_of([q if x is None else _all_of([q, _of_strings(x)]) for x, q in sides])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, item = arg
            own, query = _walk(item)
            if own is not None and low == 0 and high == 1:
                own = own | {b""}
            elif low == 0:
                own, query = None, ALL
            elif own is not None:
                more, once = high != low, own
                for _ in range(min(low, 8) - 1):
                    own = _cross(own, once) if own else own
                more |= low > 8
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        joined = _cross(run, own) if own is not None else None
        if joined is not None:
            run = joined
            if more:
                close()
        else:
            close(own)
            parts.append(query)
            if more:
                close()
    if exact:
        return run, _all_of(parts)
    return None, _all_of([*parts, _of_strings(run)])


def trigram_query(pattern: str):
    """The trigram query of an expression: ALL if nothing is mandatory."""
    exact, query = _walk(sre.parse(pattern, re.ASCII))
    return _all_of([query, _of_strings(exact)]) if exact is not None else query


def trigrams_of(query) -> set[bytes]:
    return set() if query == ALL else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


# ---- index and search ------------------------------------------------------------------------------


class Index:
    """Postings of a fixed set of trigrams for blocks of documents."""

    def __init__(self, trigrams: set[bytes]):
        self.rows = {t: k for k, t in enumerate(sorted(trigrams))}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, k in self.rows.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = k + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """data: bytes of all texts; offsets: their starts and the end. A bit row for each trigram."""
        out = np.zeros((len(self.rows), len(offsets) - 1), bool)
        for lo in range(int(offsets[0]), int(offsets[-1]), _CHUNK):
            part = self.fold[data[lo : min(lo + _CHUNK + 2, int(offsets[-1]))]].astype(np.uint32)
            if len(part) < 3:
                continue
            found = self.table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(found)
            doc = np.searchsorted(offsets, at + lo, side="right") - 1
            inside = at + lo + 3 <= offsets[doc + 1]
            out[found[at[inside]] - 1, doc[inside]] = True
        return out

    def matching(self, query, postings: np.ndarray) -> np.ndarray:
        if query == ALL:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.rows[query]]
        parts = [self.matching(q, postings) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


@functools.lru_cache(maxsize=4)
def _prepared(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    return Index(set().union(*map(trigrams_of, queries))), queries, [re.compile(r.pattern, re.ASCII) for r in rules]


def spans_of(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, less those that are too short."""
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64)) if len(texts) else np.empty(0)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CHUNK, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def scan_block(texts: pa.Array, rules: tuple[Rule, ...]) -> list[list[dict]]:
    index, queries, expressions = _prepared(rules)
    block = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    offsets = np.frombuffer(block.buffers()[1], np.int64)[block.offset : block.offset + len(block) + 1]
    data = np.frombuffer(block.buffers()[2], np.uint8) if block.buffers()[2] is not None and block.buffers()[2].size else np.empty(0, np.uint8)
    postings = index.postings(data, offsets)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    cache: dict[int, str] = {}
    for rank, (rule, query, expression) in enumerate(zip(rules, queries, expressions, strict=True)):
        for k in np.flatnonzero(index.matching(query, postings)).tolist():
            if k not in cache:
                cache[k] = block[k].as_py()
            out[k] += [{"kind": rule.kind, "start": s, "end": e, "rank": rank} for s, e in spans_of(rule, expression, cache[k])]
    for spans in out:
        spans.sort(key=lambda x: (x["start"], x["rank"]))
        for x in spans:
            del x["rank"]
    return out


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id and spans, an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for block in _blocks(batch.column(1)) for x in scan_block(block, rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[batch.schema.names[0], "spans"])

    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return df.mapInArrow(run, f"`{id_col}` {df.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
