"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are normalised to words, cut into windows of `window` consecutive words (a shorter,
non-empty item is one window) and put into a single automaton. Every document is normalised the
same way and scanned once; the ends of the matches are mapped back to words and from those to
code points of the original text.

Words are runs of digits, a-z (A-Z lower-cased) and any character from U+0080 on. Normalising works
on UTF-8 bytes, of which every one from 0x80 on belongs to a word, so bytes.translate() and
bytes.split() do all of it.

Defined results
    null or empty text: no words, no hits. Null item text: no windows. Null item id: its windows
    hit, but it is in no list of items. Repeated items and windows count once. Repeated documents
    each get a row. Empty tables give empty results, an empty benchmark hits nothing. Other columns
    are neither read nor returned by find_contamination(); drop_contaminated() returns every
    column of its input untouched, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a word stay, A-Z become a-z, everything else becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_RESULT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_RESULT_DDL = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"
_FOUND = pa.schema([("word_from", pa.list_(pa.int64())), ("word_to", pa.list_(pa.int64())), ("found_items", pa.list_(pa.string()))])
_FOUND_DDL = "word_from array<bigint>, word_to array<bigint>, found_items array<string>"

_built: dict[str, tuple[ahocorasick.Automaton, list]] = {}


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(items: Iterable[tuple[object, str | None]], window: int) -> dict[bytes, tuple[int, set[str]]]:
    """Window, between single spaces -> its number of words and the ids of its items."""
    out: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            ids = out.setdefault(b" " + b" ".join(words[i : i + n]) + b" ", (n, set()))[1]
            if item is not None:
                ids.add(str(item))
    return out


def _automaton(key: str, windows: list[tuple[bytes, int, list[str]]]):
    """Built once per Python worker. Bytes go in as latin-1, so no character is lost or split."""
    if key not in _built:
        if len(_built) >= 2:
            _built.clear()
        trie = ahocorasick.Automaton()
        for k, (pattern, _, _) in enumerate(windows):
            trie.add_word(pattern.decode("latin-1"), k)
        if windows:
            trie.make_automaton()
        _built[key] = trie, windows
    return _built[key]


def scan(words: list[bytes], trie, windows) -> tuple[list[int], list[int], set[str]]:
    """Word intervals of all occurrences (end exclusive) and the items they come from."""
    if not windows or not words:
        return [], [], set()
    norm = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(trie.iter(norm))
    if not found:
        return [], [], set()
    spaces = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
    to = np.searchsorted(spaces, np.fromiter((e for e, _ in found), np.int64, len(found)))
    kinds = [k for _, k in found]
    start = to - np.fromiter((windows[k][1] for k in kinds), np.int64, len(kinds))
    return start.tolist(), to.tolist(), {i for k in set(kinds) for i in windows[k][2]}


def _hit_words(n: int, start: list[int], to: list[int]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, to, -1)
    return np.cumsum(edge)[:n] > 0


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as code points of the original text."""
    out: list[dict] = []
    last = False
    for w, m in zip(hit.tolist(), _WORD.finditer(text), strict=True):
        if w and last:
            out[-1]["end"] = m.end()
        elif w:
            out.append({"start": m.start(), "end": m.end()})
        last = w
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[list]:
    """The windows, in blocks of about block_bytes: all that the driver and an automaton ever hold."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total * window // block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        found = windows_of(((r["i"], r["t"]) for r in part.toLocalIterator()), window)
        yield [(p, k, sorted(ids)) for p, (k, ids) in sorted(found.items())]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, item_ids (sorted strings) and spans (code points).

    A benchmark whose windows exceed block_bytes is scanned in blocks, each with its own automaton;
    intervals travel with the row from block to block, so there is never a shuffle.
    """
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    blocks = list(_blocks_broadcast(spark, benchmark, item_col, item_text_col, window, block_bytes))
    id_type = df.schema[id_col].dataType.simpleString()
    for k, (key, shared) in enumerate(blocks):
        last = k == len(blocks) - 1
        ddl = f"`{id_col}` {id_type}, " + (_RESULT_DDL if last else f"__text string, {_FOUND_DDL}")
        df = df.mapInArrow(_pass(key, shared, k > 0, last), ddl)
    return df


def _blocks_broadcast(spark, benchmark, item_col, text_col, window, block_bytes):
    for windows in _blocks(benchmark, item_col, text_col, window, block_bytes):
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(windows)


def _pass(key: str, shared, carried: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, windows = _automaton(key, shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            before = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True) if carried else ([],) * len(texts)
            rows = []
            for text, old in zip(texts, before, strict=True):
                words = words_of(text)
                start, to, items = scan(words, trie, windows)
                if old:
                    start, to, items = old[0] + start, old[1] + to, items | set(old[2])
                if not last:
                    rows.append((start, to, sorted(items)))
                elif not start:
                    rows.append((len(words), 0, [], []))
                else:
                    hit = _hit_words(len(words), start, to)
                    rows.append((len(words), int(hit.sum()), sorted(items), _spans(text, hit)))
            kinds = _RESULT if last else _FOUND
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)] if rows else [pa.array([], t) for t in kinds.types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *([] if last else [batch.column(1)]), *cols], names=[batch.schema.names[0], *([] if last else ["__text"]), *kinds.names])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 64 << 20) -> DataFrame:
    """The documents without any word inside an occurrence of a window, with all their columns."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    df = docs
    for key, shared in _blocks_broadcast(spark, benchmark, item_col, item_text_col, window, block_bytes):
        df = df.mapInArrow(_filter(key, shared, at), docs.schema)
    return df


def _filter(key: str, shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what Arrow holds of the worker's last task
        trie, windows = _automaton(key, shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # a copy of a whole batch would be held here and once more by the JVM
                some = batch.slice(lo, 500)
                clean = [not scan(words_of(t), trie, windows)[0] for t in some.column(at).to_pylist()]
                yield some.filter(pa.array(clean, pa.bool_()))

    return run
