"""SimHash fingerprints and the exact Hamming self-join.

A fingerprint is a vote of the FNV-1a hashes of all tokens on each of 64 bits. The join is exact: with
`blocks` disjoint blocks of bits and at most t differing bits, blocks - t blocks agree, so each choice of that
many blocks is a key for an equi-join. blocks = t + 1 gives few wide buckets; more blocks give longer
keys and more of them, for large corpora. Documents with equal fingerprints are one class throughout, and
pairs are pairs of classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import FNV_OFFSET, FNV_PRIME
from textquarry.operators.components import connected_components
from textquarry.sources.shared import written


#: Bytes of a-z and 0-9; of a token's hash four bits each as four lanes of 16 bits; tokens whose lanes are added up at once.
_IN_TOKEN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
_LANES = (np.arange(16)[:, None] >> np.arange(4) & 1).astype("<u2").view("<u8").ravel()
_AT_ONCE = 60_000
#: Bytes of text that are hashed at once, and characters behind which few tokens are left.
_PORTION, _LONG = 1 << 20, 64


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a of all tokens, one character of each at a time; what is left of a few long ones goes one by one."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    h = np.full(len(at), FNV_OFFSET, np.uint64)
    for p in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -p, "left"))
        if p >= _LONG and k < 16:
            for j in range(k):
                value = int(h[j])
                for byte in data[at[j] + p : at[j] + left[j]].tolist():
                    value = (value ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
                h[j] = value
            break
        h[:k] = (h[:k] ^ data[at[:k] + p]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def _votes(texts: list[bytes]) -> np.ndarray:
    """The fingerprints of some texts. Bits set are counted in lanes, four to a number, and those of a text added up."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    edges = np.diff(_IN_TOKEN[data].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    h, text = _hashes(data, starts, ends - starts), np.searchsorted(ends_of_texts, starts, "right")
    ones = np.zeros((len(texts), 64), np.int64)
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    for k in range(0, len(h), _AT_ONCE):
        lanes = _LANES[(h[k : k + _AT_ONCE, None] >> shifts & np.uint64(15)).astype(np.intp)]
        part = text[k : k + _AT_ONCE]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        ones[part[first]] += np.ascontiguousarray(np.add.reduceat(lanes, first, axis=0)).view("<u2").reshape(-1, 64)
    bits = 2 * ones > np.bincount(text, minlength=len(texts))[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def _fingerprints(texts: pd.Series) -> pd.Series:
    """texts: in lower case, without nulls."""
    out, some, size = [], [], 0
    for t in texts:
        some.append(t.encode())
        size += len(some[-1])
        if size >= _PORTION:
            out.append(_votes(some))
            some, size = [], 0
    if some:
        out.append(_votes(some))
    return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): one pass without a shuffle; tokens are found, hashed and counted on Arrow batches. A text without tokens gets 0."""
    vote = F.pandas_udf(_fingerprints, "bigint")
    return docs.select(F.col(id_col).alias("doc_id"), vote(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("fingerprint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(threshold: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks - threshold blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen) for chosen in combinations(range(blocks), blocks - threshold)]


def _and(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _keys(bits: Column, masks: list[int]) -> list[Column]:
    """A struct (choice of blocks, their bits) for every choice."""
    return [F.struct(F.lit(n).alias("n"), _and(bits, mask).alias("bits")) for n, mask in enumerate(masks)]


def classes(prints: DataFrame) -> DataFrame:
    """(fingerprint, doc_id, copies): documents with one fingerprint, the smallest id standing for them."""
    return prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def blocks_for(n: int, threshold: int, bucket: int = 16) -> int:
    """The fewest blocks whose keys split n fingerprints into buckets of about `bucket`; at most three more than needed."""
    for blocks in range(threshold + 1, threshold + 4):
        if n >> (64 * (blocks - threshold) // blocks) < bucket:
            break
    return blocks


def _keyed(reps: DataFrame, threshold: int, blocks: int | None) -> tuple[DataFrame, list[int]]:
    masks = _masks(threshold, blocks or blocks_for(reps.count(), threshold))
    return reps.select("doc_id", "fingerprint", F.explode(F.array(*_keys(F.col("fingerprint"), masks))).alias("key")), masks


def near_pairs(prints: DataFrame, threshold: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b, distance): classes, by their smallest ids, whose fingerprints differ in 1 to threshold bits.

    The classes are written first: the self-join reads them twice. Without blocks their number sets the keys. A pair
    that meets by several keys comes from the first of them, so pairs aren't shuffled to be made distinct.
    """
    keyed, masks = _keyed(written(classes(prints), "classes"), threshold, blocks)
    a, b = keyed.alias("a"), keyed.alias("b").hint("merge")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    differ = F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))
    first = F.array_position(F.array(*(_and(differ, mask) for mask in masks)), F.lit(0).cast("long")) - 1
    met = met.where(F.bit_count(differ) <= threshold).where(first == F.col("a.key.n"))
    return met.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.bit_count(differ).alias("distance"))


def _trees(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows (n, bits, doc_id, fingerprint) in the order of n and bits -> edges (a, b) that link what lies within the threshold in a bucket.

    Each row of a bucket is compared, in numpy, with those that no row before it has reached, which are few where many are near.
    """
    kept: list[np.ndarray] = []

    def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
        n, bits, ids, prints = rows
        borders = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (bits[1:] != bits[:-1]), [True]]))
        sizes, left, right = np.diff(borders), [], []
        for at, size in zip(borders[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            own, words = ids[at : at + size], prints[at : at + size].view(np.uint64)
            free, reached = np.arange(1, size), [0]
            while len(free):
                k = reached.pop() if reached else None
                if k is None:  # another component
                    k, free = free[0], free[1:]
                near = np.bitwise_count(words[free] ^ words[k]) <= threshold
                if near.any():
                    hit = free[near]
                    left.append(np.full(len(hit), own[k]))
                    right.append(own[hit])
                    reached.extend(hit.tolist())
                    free = free[~near]
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(join(left), pa.int64()), pa.array(join(right), pa.int64())], names=["a", "b"])

    for batch in batches:
        rows = [np.concatenate(x) for x in zip(*kept, _columns(batch), strict=True)] if kept else _columns(batch)
        if not len(rows[0]):
            continue
        # the last bucket may go on in the next batch
        end = len(rows[0]) - int(np.argmin(np.append((rows[0] == rows[0][-1])[::-1] & (rows[1] == rows[1][-1])[::-1], False)))
        if end:
            yield edges([x[:end] for x in rows])
        kept = [[x[end:] for x in rows]]
    if kept:
        yield edges(kept[0])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def near_links(reps: DataFrame, threshold: int, blocks: int | None = None) -> DataFrame:
    """(a, b): enough of the near pairs of classes to link all that they link, at most one for each class and key."""
    keyed, _ = _keyed(reps, threshold, blocks)
    rows = keyed.select("key.n", "key.bits", F.col("doc_id").cast("long").alias("doc_id"), "fingerprint").repartition("n", "bits").sortWithinPartitions("n", "bits")
    return rows.mapInArrow(lambda batches: _trees(batches, threshold), "a bigint, b bigint")


def first_pairs(prints: DataFrame, threshold: int = 3, n: int = 12) -> DataFrame:
    """The first n pairs by their ids."""
    return near_pairs(prints, threshold).orderBy("a", "b").limit(n)


def groups(prints: DataFrame, threshold: int = 3, blocks: int | None = None, least: int = 2) -> DataFrame:
    """(group_id, size, doc_id): members of single-linkage groups of at least `least` documents; group_id is the smallest id."""
    prints = written(prints, "prints")
    reps = written(classes(prints), "classes")
    roots = connected_components(near_links(reps, threshold, blocks), loops=False)
    labelled = reps.join(roots, reps["doc_id"] == roots["node"], "left").select("fingerprint", "copies", F.coalesce("component", "doc_id").alias("group_id"))
    sizes = labelled.groupBy("group_id").agg(F.sum("copies").alias("size")).where(F.col("size") >= least)
    members = prints.join(labelled.select("fingerprint", "group_id"), "fingerprint").join(sizes, "group_id")
    return members.select("group_id", "size", "doc_id")
