"""I-Match document fingerprints over randomised lexicons.

The lexicon holds the terms within a band of inverse document frequency, counted over all documents.
It is kept as one bit for each of 2**24 cells to which terms are hashed: two megabytes, whatever the
corpus; terms that share a cell share its count, and the band is one of shares of the documents so that this
does not grow with the corpus. A document's distinct terms in the lexicon are sorted
and hashed for the whole lexicon and for random subsets of it. A subset holds a term if a keyed hash of
the term lies under its rate; rates fall from 1/4 to 1/1024, so that for short and long documents
alike some subsets hold few of its terms and outlive an edit. The fingerprint is the list of hashes, 32
bits each, 0 where a document has no term of the subset.

likeness() is the weighted share of equal hashes among the subsets that have terms of either document;
subsets of low rate, which say more, weigh more. Equal fingerprints give 1.

Defined results
    null text: empty. Without terms in the lexicon all terms count; a text without any term is hashed
    itself, so equal texts always have equal fingerprints and different ones hardly ever. Null ids come
    last in the order of documents, equal ids are ordered by their compressed texts; a single document is its own next
    one. Empty table: no rows. Other columns are neither read nor returned. Memory is bounded by an
    Arrow batch.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.decontaminate import words_of
from textquarry.llm.shingles import WordHashes, mix
from textquarry.sources.shared import written

CELL_BITS = 24
_CHUNK = 4096
#: Rates of the subsets, the whole lexicon first: six subsets for each power of two.
RATES = (1.0, *(2.0**-k for k in range(2, 11) for _ in range(6)))

_SEEDS = mix(np.arange(1, len(RATES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BELOW = np.array([min(int(r * 2**64), 2**64 - 1) for r in RATES], np.uint64)
_WEIGHT = np.array([r**-0.5 for r in RATES])


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per cell in this task, as compressed runs of cells."""
    counts, hashes = np.zeros(1 << CELL_BITS, np.uint32), WordHashes()
    for batch in batches:
        for text in batch.column(0):
            terms = set(words_of(text.as_py()))
            cells = np.unique(_cells(np.fromiter(map(hashes.__getitem__, terms), np.uint64, len(terms))))
            counts[cells] += 1
    rows = [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(counts.reshape(-1, _CHUNK)) if part.any()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["chunk", "counts"])


def _band(least: int, most: int):
    """Rows sorted by chunk -> a bit for each cell whose documents number from least to most."""

    def bits(total: np.ndarray) -> bytes:
        return np.packbits((total >= least) & (total <= most)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            done = []
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk != now:
                    if now is not None:
                        done.append((now, bits(total)))
                    now, total = chunk, np.zeros(_CHUNK, np.int64)
                total += np.frombuffer(zlib.decompress(counts), np.uint32)
            yield _pairs(done)
        if now is not None:
            yield _pairs([(now, bits(total))])

    def _pairs(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "bits"])

    return run


def fit_lexicon(docs: DataFrame, *, text_col: str = "text", least_documents: int = 2, least_share: float = 1e-5, most_share: float = 0.2) -> np.ndarray:
    """The lexicon as booleans by cell. The band is idf from ln(1 / most_share) to ln(1 / least_share), of least_documents at least.

    Both ends are shares of the documents, so what rare terms that share a cell add to one another stays the
    same part of the bound whatever the corpus: a fixed number of documents is passed by every cell of a large one.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    n = docs.count()
    least_documents = max(least_documents, math.ceil(n * least_share))
    most = max(least_documents, int(n * most_share))
    counts = texts.mapInArrow(_count_cells, "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros(((1 << CELL_BITS) // _CHUNK, _CHUNK), bool)
    found = counts.mapInArrow(_band(least_documents, most), "chunk int, bits binary").toArrow()
    for chunk, bits in zip(found.column("chunk").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[chunk] = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return out.ravel()


def fingerprint(text: str | None, lexicon: np.ndarray, hashes: WordHashes) -> np.ndarray:
    """The hashes of a text, one for each of RATES."""
    terms = sorted(set(words_of(text)))
    if not terms:
        return np.full(len(RATES), xxhash.xxh32_intdigest((text or "").encode("utf-8", "surrogatepass")) | 1, np.uint32)
    h = np.fromiter(map(hashes.__getitem__, terms), np.uint64, len(terms))
    kept = h[lexicon[_cells(h)]]
    h = kept if len(kept) else h
    out = np.zeros(len(RATES), np.uint32)
    out[0] = xxhash.xxh32_intdigest(h.tobytes()) or 1
    for k, inside in enumerate(mix(h[None, :] ^ _SEEDS[1:, None]) < _BELOW[1:, None], 1):
        if inside.any():
            out[k] = xxhash.xxh32_intdigest(h[inside].tobytes()) or 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    either = (a != 0) | (b != 0)
    return float(_WEIGHT[(a == b) & either].sum() / _WEIGHT[either].sum())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the beginning of the next text, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROW = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_ROW_DDL = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compare(text: str, own: np.ndarray, following: str, other: np.ndarray, lexicon, hashes) -> tuple:
    new = edited(text, following)
    changed = own if new == text else fingerprint(new, lexicon, hashes)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, own.astype(">u4").tobytes(), changed.astype(">u4").tobytes(), likeness(own, changed), likeness(own, other)


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lexicon: np.ndarray | None = None) -> DataFrame:
    """(id, fingerprint) of every document, as binary."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_lexicon(docs, text_col=text_col) if lexicon is None else lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = [fingerprint(t.as_py(), shared.value, hashes).astype(">u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[batch.schema.names[0], "fingerprint"])

    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return df.mapInArrow(run, f"`{id_col}` {df.schema[0].dataType.simpleString()}, fingerprint binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [pack.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=batch.schema.names)


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likeness to that and to the next document.

    Documents are dealt out by ranges of ids and read in order. Within a range each row meets its next
    one; the first and last rows of the ranges, two for each, are written with their texts and matched
    afterwards, so no task holds more than a batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_lexicon(docs, text_col=text_col))
    df = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_kind = df.schema[0].dataType.simpleString()
    order = F.col(id_col).asc_nulls_last()
    df = df.mapInArrow(_pack, f"`{id_col}` {id_kind}, text binary").repartitionByRange(order).sortWithinPartitions(order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, hashes, part = shared.value, WordHashes(), TaskContext.get().partitionId()
        before, kind, unpack = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, rows, ends = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = unpack.decompress(t.as_py()).decode("utf-8", "surrogatepass")
                own = fingerprint(text, lexicon, hashes)
                if before is None:
                    ids.append(i)
                    rows.append((None,) * len(_ROW))
                    ends.append((0, text))
                else:
                    ids.append(before[0])
                    rows.append(_compare(before[1], before[2], text, own, lexicon, hashes))
                    ends.append((None, None))
                before = i, text, own
            yield _batch(ids, rows, ends, kind, part)
        if before is not None:
            yield _batch([before[0]], [(None,) * len(_ROW)], [(1, before[1])], kind, part)

    def _batch(ids, rows, ends, kind, part):
        cols = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_ROW)]
        cols = [pa.array(ids, kind), *cols, pa.array([e[0] for e in ends], pa.int32()), pa.array([part] * len(ids), pa.int32()), pa.array([e[1] for e in ends], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, *(n for n, _ in _ROW), "edge", "part", "text"])

    all_rows = written(df.mapInArrow(run, f"`{id_col}` {id_kind}, {_ROW_DDL}, edge int, part int, text string"), "fingerprints")
    edges = all_rows.where("edge is not null")
    heads, tails = edges.where("edge = 0"), edges.where("edge = 1")
    parts = heads.select("part")  # one row for each task above
    following = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"))
    first = parts.agg(F.min("part").alias("first"))
    following = following.join(F.broadcast(first)).select("part", F.coalesce("after", "first").alias("after"))
    met = tails.select(F.col(id_col), F.col("text"), "part").join(following, "part").join(heads.select(F.col("part").alias("after"), F.col("text").alias("next_text")), "after")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, hashes = shared.value, WordHashes()
        for batch in batches:
            rows = []
            for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows.append(_compare(t, fingerprint(t, lexicon, hashes), n, fingerprint(n, lexicon, hashes), lexicon, hashes))
            cols = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_ROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, *(n for n, _ in _ROW)])

    stitched = met.select(id_col, "text", "next_text").mapInArrow(meet, f"`{id_col}` {id_kind}, {_ROW_DDL}")
    return all_rows.where("edge is null").drop("edge", "part", "text").unionByName(stitched)
