"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` tokens. What is packed is the histogram of piece
lengths, at most `capacity` numbers whatever the corpus, so the search runs on the driver: for each
bin the longest length left is fixed, and a bitset subset-sum over the lengths available finds the
fullest combination with it. The combination is then removed as often as the counts allow, which is
what repeating the search bin by bin would do. Each piece has a rank among the pieces of its length,
and the plan maps ranges of ranks to sequences.

Ranks need no group of one length in one place: a piece carries its running number within the task
that cut it, and a sum over tasks gives each task its first rank.

Defined results
    null or empty text: one piece that holds the end id alone. Null or repeated ids: each row is a
    document of its own. Empty table: no pieces. Other columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm import tokens
from textquarry.sources.shared import written

_PIECES = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
_PIECES_DDL = "piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def fullest(counts: dict[int, int], room: int) -> Counter:
    """Lengths of a fullest combination that fits into room, at most counts[length] of each.

    Reachable sums are the bits of an integer. Lengths come in descending order, each in lots of
    1, 2, 4, ... of it, until room itself is reachable, so that of equally full combinations one of
    long pieces is found and the short ones stay for later gaps.
    """
    mask, reach, lots = (1 << (room + 1)) - 1, 1, []
    for length in sorted((k for k in counts if k <= room and counts[k] > 0), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(lot, left)
            lots.append((length, take, reach))
            reach |= reach << length * take & mask
            left, lot = left - take, lot * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(lots):
        if not before >> at & 1:
            out[length] += take
            at -= length * take
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, times) of all bins."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        found = fullest(left, capacity - top)
        left[top] += 1
        found[top] += 1
        times = min(left[k] // v for k, v in found.items())
        for k, v in found.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
        out.append((dict(found), times))
    return out


def plan_ranges(bins: list[tuple[dict[int, int], int]], capacity: int) -> np.ndarray:
    """Rows (length * span + first rank, first rank, pieces a bin, first sequence, first offset), by the first.

    A combination uses up one length at least or halves what is left of one, and sums of distinct
    lengths stay within capacity, so the plan has a bounded number of rows.
    """
    used, rows, sequence, span = Counter(), [], 0, 1 << 44
    for found, times in bins:
        at = 0
        for length in sorted(found, reverse=True):
            rows.append((length * span + used[length], used[length], found[length], sequence, at))
            used[length] += found[length] * times
            at += found[length] * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_documents(docs: DataFrame, *, id_col: str, text_col: str, capacity: int, end_id: int, ranks_path: str, keep_ids: bool = False) -> DataFrame:
    """One row per piece, with the task that cut it and its running number there among equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = tokens.load(ranks_path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                rows, source, kept = [], [], []
                for k, text in enumerate(some.column(1)):
                    ids = np.append(tokens.encode(encoder, text.as_py()), np.uint32(end_id)).astype("<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append((piece, start, length, zlib.crc32(own), part, seen[length]))
                        seen[length] += 1
                        source.append(k)
                        if keep_ids:
                            kept.append(own)
                cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PIECES, strict=True)] if rows else [pa.array([], t) for _, t in _PIECES]
                names = [batch.schema.names[0], *(n for n, _ in _PIECES)]
                cols = [some.column(0).take(pa.array(source, pa.int64())), *cols]
                if keep_ids:
                    cols, names = [*cols, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    ddl = f"`{id_col}` {df.schema[0].dataType.simpleString()}, {_PIECES_DDL}" + ", ids array<bigint>" * keep_ids
    return df.mapInArrow(run, ddl)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids also its ids."""
    spark = docs.sparkSession
    path = ranks_path or tokens.tokenizer_path("byte_bpe_50k.tiktoken")
    pieces = written(cut_documents(docs, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, ranks_path=path, keep_ids=keep_ids), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    shared = spark.sparkContext.broadcast(plan_ranges(plan_bins(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "part"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"), *(["ids"] if keep_ids else [])
    )
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            row = ranges[np.searchsorted(ranges[:, 0], length * (1 << 44) + rank, side="right") - 1]
            times, slot = np.divmod(rank - row[:, 1], row[:, 2]) if len(rank) else (rank, rank)
            cols = [*batch.columns[:5], pa.array(row[:, 3] + times, pa.int64()), pa.array(row[:, 4] + slot * length, pa.int64()), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:5], "sequence_id", "offset", *batch.schema.names[6:]])

    return ranked.mapInArrow(place, ddl)
