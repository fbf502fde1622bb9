"""Exact n-gram Jaccard join with PartEnum signatures.

Sizes are divided into bands [l, l / s**2] (l / s for a similarity s under 0.75). A pair belongs to the band of its
smaller set; a set signs for its own band and, if it can be the larger one of a pair there, for the
band below. Two sets of a similarity of s or more whose smaller one has a features differ in at most
k = (1 - s) / s * a of them. So a band divides the feature domain into n1 parts, and each of these into
n2: where at most k features differ, some first-level part holds at most k2 = k // n1 of the differences,
hence n2 - k2 of its second-level parts are equal in both sets. Every subset of n2 - k2 second-level parts
is enumerated, and the features within a subset, with band, part and subset, make one signature. n1, n2
and k2 are chosen for each band: the fewest signatures with DENSITY features each on average or, where no choice
has as many, the densest that at most doubles their number.

Empty subsets agree too, which would bring together many sets that have nothing in common. A band has
e first-level parts more than needed, so similar sets agree in e + 1 of them; a set with up to e parts
that have an empty subset needs no signature for empty ones. Nothing is lost.

One document of each class of equal sets signs. Among the sets that share a signature, sketches of 128 bytes,
whose difference is never more than that of the sets, tell which pairs can be similar at all; the
connected components of those are the blocks. Blocks with sets too large for such sketches are told apart once more by
sketches that grow with the set. Within a block every set is replaced by its difference from
one set of the block, the reference: two sets differ in exactly the features in which their
differences from the reference do, so near copies are compared at the cost of what sets them apart.
Blocks are divided by the number of these features and of sets, so that a task holds a bounded number of bytes,
and each pair of divisions is a task of its own; no pair of sets is ever emitted, only a spanning
forest of links and, where asked for, the links' number per set. Without numbers of links, sets
that are similar to the reference need no comparison with one another.

Equal sets are one class throughout, whatever their number.

Defined results
    null or empty text, or one without words: n_shingles 0, linked with nothing, a component of its own
    (its id; null if that is null). Null ids: the row takes part, and the component has the smallest id
    that is not null. Repeated rows are members of one class. Empty table: no rows. Other columns are
    neither read nor returned by jaccard_components(); keep_one() returns those of its input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from textquarry.llm.shingles import WordHashes, mix, set_key, shingle_set
from textquarry.operators.components import connected_components
from textquarry.sources.shared import written

#: Bits of a filter that tells which documents are asked for: 8 MB, whatever the corpus. Where it fills up,
#: more documents than needed are sent on, and the join behind it drops them.
_FILTER_BITS = 1 << 26
#: Parts of the domain whose counts bound the difference of two sets; one byte each. Larger sets have a fine sketch too.
SKETCH = 128
#: Features for each part of a fine sketch: unrelated sets then differ far more than the bound.
PER_PART = 4
#: Features that a signature covers on average, at least, where the choice of parts allows it.
DENSITY = 2.0
#: Features and sets of one division of a block.
DIVISION_FEATURES = 1 << 20
#: Sets of a group whose sketches are compared all at once.
_SMALL = 48
#: Bytes of sketches of one division.
_DIVISION_SKETCHES = 8 << 20


class Bands:
    """Size bands for a similarity of percent / 100, with the parts of each."""

    def __init__(self, percent: int):
        self.percent, self.low, self.high, self.shape = percent, [], [], []

    def _choose(self, low: int, k: int) -> tuple[int, int, int, int]:
        """n1, n2, k2 and spare first-level parts."""
        options = []
        for k2 in range(3):
            for n2 in range(k2 + 1, k2 + 4):
                needed = k // (k2 + 1) + 1
                options.append((needed * math.comb(n2, k2), low * (n2 - k2) / (needed * n2), needed, n2, k2))
        enough = [x for x in options if x[1] >= DENSITY]
        least = min(options)[0]
        _, dense, needed, n2, k2 = min(enough) if enough else max((x for x in options if x[0] <= 2 * least), key=lambda x: (x[1], -x[0]))
        # parts with an empty subset, as if features fell independently, and a margin
        empty = min(1.0, math.comb(n2, k2) * math.exp(-dense)) * needed
        spare = math.ceil(1.25 * empty + 3 * math.sqrt(empty)) if k else 0
        return needed + spare, n2, k2, spare

    def reach(self, size: int) -> int:
        """The band of a size."""
        while not self.high or self.high[-1] < size:
            low = self.high[-1] + 1 if self.high else 1
            high = low * 100 // self.percent
            if self.percent >= 75:
                high = high * 100 // self.percent
            self.low.append(low)
            self.high.append(high)
            self.shape.append(self._choose(low, (100 - self.percent) * high // self.percent))
        return int(np.searchsorted(self.high, size))

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """features: sorted distinct hashes. Parts are equal ranges of the hash, so they are slices."""
        band = self.reach(len(features))
        bands = [band]
        if band and self.percent * len(features) <= 100 * self.high[band - 1]:
            bands.append(band - 1)
        total = np.zeros(len(features) + 1, np.uint64)
        np.cumsum(mix(features), out=total[1:])
        out = []
        for b in bands:
            n1, n2, k2, spare = self.shape[b]
            n = n1 * n2
            part = ((features >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            edge = np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))
            sums, sizes = (total[edge[1:]] - total[edge[:-1]]).reshape(n1, n2), np.diff(edge).reshape(n1, n2)
            chosen = list(combinations(range(n2), n2 - k2))
            value = np.stack([sums[:, list(c)].sum(axis=1, dtype=np.uint64) for c in chosen], axis=1)
            filled = np.stack([sizes[:, list(c)].sum(axis=1) for c in chosen], axis=1) > 0
            signed = filled if int((~filled.all(axis=1)).sum()) <= spare else np.ones_like(filled)
            name = np.arange(value.size, dtype=np.uint64).reshape(value.shape) + np.uint64((b + 1) << 40)
            out.append(mix(value ^ mix(name))[signed])
        return np.concatenate(out)


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def sketch(features: np.ndarray, parts: int = SKETCH) -> bytes:
    """How many features lie in each of so many parts of the domain, a power of two; 255 at most.

    The counts of two sets differ by no more, all together, than the sets do. Adding neighbours makes a sketch of fewer parts.
    """
    counts = np.bincount((mix(features) >> np.uint64(65 - parts.bit_length())).astype(np.int64), minlength=parts)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def fine_sketch(features: np.ndarray) -> bytes | None:
    """None where the short sketch is fine enough."""
    parts = 1 << max(0, (len(features) - 1) // PER_PART).bit_length()
    return sketch(features, parts) if parts > SKETCH else None


def _set_rows(size: int):
    """id, text_hash, n_shingles, class, sketch (both null for an empty set) and fine sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what Arrow holds of the worker's last task
        hashes = WordHashes()
        for batch in batches:
            n, keys, sketches, fine = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size, hashes)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                sketches.append(sketch(s) if len(s) else None)
                fine.append(fine_sketch(s))
            cols = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary()), pa.array(fine, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "text_hash", "n_shingles", "class", "sketch", "fine"])

    return run


# ---- a filter over documents ------------------------------------------------------------------------


def filter_places(ids: pa.Array, text_hashes: pa.Array) -> np.ndarray:
    """Which bit of the filter stands for a document, told by its id and the hash of its text."""
    i = np.asarray(ids.cast(pa.int64()).fill_null(-1)).view(np.uint64)
    h = np.asarray(text_hashes.cast(pa.int64()).fill_null(0)).view(np.uint64)
    return (mix(h ^ mix(i)) >> np.uint64(38)).astype(np.int64)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = filter_places(batch.column(0), batch.column(1))
        bits = (np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(bits)], names=["word", "bits"])


class Filter:
    """A broadcast bit set of documents (id, text_hash): never misses one, and lets a few others pass."""

    def __init__(self, chosen: DataFrame):
        words = chosen.select("id", "text_hash").mapInArrow(_filter_words, "word bigint, bits bigint")
        found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        bitmap = np.zeros(_FILTER_BITS >> 6, np.int64)
        bitmap[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
        self.shared = chosen.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def test(self):
        """A function of Arrow columns id and text_hash, for use in tasks."""
        shared = self.shared

        def inside(ids: pa.Array, text_hashes: pa.Array) -> np.ndarray:
            place = filter_places(ids, text_hashes)
            return (shared.value[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

        return inside

    def holds(self, doc: Column, text_hash: Column) -> Column:
        inside = self.test()
        return F.arrow_udf(lambda i, h: pa.array(inside(i, h)), BooleanType())(doc, text_hash)


def _signature_rows(size: int, percent: int, inside):
    """(sign, class) of the set of every document that stands for its class, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what Arrow holds of the worker's last task
        hashes, bands, seen = WordHashes(), Bands(percent), set()
        for batch in batches:
            asked = np.flatnonzero(inside(batch.column(0), batch.column(2))).tolist()
            for lo in range(0, len(asked), 200):  # a set has hundreds of signatures: those of a whole batch outweigh its texts
                signs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for k in asked[lo : lo + 200]:
                    s = shingle_set(batch.column(1)[k].as_py(), size, hashes)
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(key)
                    signs.append(bands.signatures(s))
                    owners.append(np.full(len(signs[-1]), key, np.int64))
                cols = [pa.array(np.concatenate(signs).view(np.int64)), pa.array(np.concatenate(owners))]
                yield pa.RecordBatch.from_arrays(cols, names=["sign", "class"])

    return run


def _packed(inside):
    """The documents that the filter lets pass, with their texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(pa.array(inside(batch.column(0), batch.column(2))))
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                texts = [pack.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(texts, pa.binary())], names=["id", "text_hash", "packed"])

    return run


# ---- comparison -------------------------------------------------------------------------------------


def _is_similar(percent: int, size_a: int, sizes: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that differ in so many features have the similarity."""
    both = (size_a + sizes - differ) // 2
    return (both > 0) & (100 * both >= percent * (size_a + sizes - both))


_DELTA_DDL = "block bigint, class bigint, copies bigint, n bigint, near boolean, features binary"


def _deltas(size: int, percent: int):
    """Rows sorted by block, portion and whether they are the reference -> each set's difference from the reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack, now, reference = WordHashes(), zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(lo, 200).to_pylist():
                    s = shingle_set(unpack.decompress(r["packed"]).decode("utf-8", "surrogatepass"), size, hashes)
                    if r["leads"]:
                        now, reference = (r["block"], r["portion"]), s
                        if r["portion"] == 0:
                            out.append((r["block"], r["class"], r["copies"], len(s), True, b""))
                        continue
                    assert now == (r["block"], r["portion"])
                    delta = np.setxor1d(s, reference, assume_unique=True)
                    near = bool(_is_similar(percent, len(s), np.array([len(reference)]), np.array([len(delta)]))[0])
                    out.append((r["block"], r["class"], r["copies"], len(s), near, delta.tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["block", "class", "copies", "n", "near", "features"])

    return run


def similar_sets(sizes: np.ndarray, deltas: list[np.ndarray], percent: int, left: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set its similar ones among the later sets, or, with `left`, for each of the first `left` sets those among the rest.

    deltas are the sets' differences from one and the same set.
    """
    own = np.array([len(d) for d in deltas], np.int64)
    owner = np.repeat(np.arange(len(deltas)), own)
    _, feature, df = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
    order = np.argsort(feature, kind="stable")
    posting, ends = owner[order], np.cumsum(df)
    at = np.cumsum(own) - own
    for a in range(len(deltas) if left is None else left):
        begin = a + 1 if left is None else left
        shared = feature[at[a] : at[a] + own[a]]
        shared = shared[df[shared] > 1]
        if len(shared):
            n = df[shared]
            places = np.repeat(ends[shared] - np.cumsum(n), n) + np.arange(int(n.sum()))
            common = np.bincount(posting[places], minlength=len(deltas))[begin:]
        else:
            common = 0
        differ = own[a] + own[begin:] - 2 * common
        yield a, begin + np.flatnonzero(_is_similar(percent, sizes[a], sizes[begin:], differ))


def _compare(percent: int, between: bool = False):
    """One division of a block, or a pair of them: a spanning forest of its links (a, b) and, as (a, a, n), the links' number.

    between: sets of one side are always compared with those of the other only.
    """

    def run(key, table):
        side = np.asarray(table.column("side"))
        rows = np.argsort(side, kind="stable")
        keys, copies, sizes = (np.asarray(table.column(c))[rows] for c in ("class", "copies", "n"))
        features = table.column("features")
        deltas = [np.frombuffer(features[int(k)].as_buffer(), np.uint64) for k in rows]
        left = int((side == 0).sum()) if between or key[1].as_py() != key[2].as_py() else None
        label, degree, out = np.arange(len(keys)), np.zeros(len(keys), np.int64), []
        for a, similar in similar_sets(sizes, deltas, percent, left):
            similar = similar[keys[similar] != keys[a]]
            degree[a] += copies[similar].sum()
            degree[similar] += copies[a]
            for b in similar[label[similar] != label[a]].tolist():
                if label[b] != label[a]:
                    out.append((keys[a], keys[b], 0))
                    label[label == label[b]] = label[a]
        out += [(keys[k], keys[k], degree[k]) for k in np.flatnonzero(degree)]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "links"])

    return run


def _buckets(signed: DataFrame) -> DataFrame:
    """(block, class): the classes that share a signature, each set of them once.

    Near copies share most of their signatures, so a bucket is named by its number of rows and its first and
    last members and dealt out once; two buckets that meet in one name are joined, which loses nothing.
    """
    w = Window.partitionBy("sign")
    mixed = F.xxhash64("class")
    named = signed.select("class", F.count("*").over(w).alias("n"), *(f(c).over(w).alias(f"{f.__name__}_{k}") for k, c in (("c", F.col("class")), ("h", mixed)) for f in (F.min, F.max)))
    named = named.where("min_c <> max_c").select(F.xxhash64("n", "min_c", "max_c", "min_h", "max_h").alias("block"), "class")
    return written(named.distinct(), "buckets")


def _dealt(rows: DataFrame, divisions: DataFrame) -> DataFrame:
    """The rows of blocks for each pair (x, y) of a block's divisions; side tells whether a row is of the first or second."""
    dealt = rows.join(divisions, "block").withColumn("own", F.pmod(F.xxhash64("class"), F.col("divisions")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("divisions") - 1)))
    kept = [c for c in rows.columns if c != "block"]
    return dealt.select("block", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), *kept)


def _tasks(df: DataFrame) -> int:
    """As many tasks as the session shuffles to: groups are small in bytes but costly, so AQE must not gather them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def possible_pairs(sizes: np.ndarray, sketches: list[bytes], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches allow them to be similar; with `left`, of pairs of the first `left` sets and the rest."""
    parts = np.array([len(x) for x in sketches])
    if len(sketches) <= _SMALL and (parts == parts[0]).all():
        return _all_at_once(sizes, np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1).astype(np.int16), percent, left)
    # at each number of parts the sketches that have as many or more, folded to it
    levels = {}
    for m in np.unique(parts).tolist():
        rows = np.flatnonzero(parts >= m)
        place = np.full(len(parts), -1)
        place[rows] = np.arange(len(rows))
        levels[m] = place, np.stack([np.frombuffer(sketches[k], np.uint8).reshape(m, -1).sum(axis=1, dtype=np.int32) for k in rows])
    label, out = np.arange(len(sizes)), []
    # one set against all later ones (or all of the other side) at a time; those already connected are left out
    for a in range(len(sizes) if left is None else left):
        others = np.arange(a + 1 if left is None else left, len(sizes))
        others = others[label[others] != label[a]]
        if not len(others):
            continue
        differ, shared = np.zeros(len(others), np.int64), np.minimum(parts[others], parts[a])
        for m in np.unique(shared).tolist():
            place, counts = levels[m]
            some = shared == m
            differ[some] = np.abs(counts[place[others[some]]] - counts[place[a]]).sum(axis=1)
        found = others[(100 + percent) * differ <= (100 - percent) * (sizes[others] + sizes[a])]
        if len(found):
            out += [(a, b) for b in found.tolist()]
            label[np.isin(label, label[found])] = label[a]
    return out


def _all_at_once(sizes: np.ndarray, counts: np.ndarray, percent: int, left: int | None) -> list[tuple[int, int]]:
    """possible_pairs() of a small group whose sketches have one length."""
    n, out = len(sizes), []
    differ = np.abs(counts[:left, None, :] - counts[None, :, :]).sum(axis=2, dtype=np.int64)
    met = (100 + percent) * differ <= (100 - percent) * (sizes[:left, None] + sizes[None, :])
    if left is None:
        met = np.triu(met, 1)
    else:
        met[:, :left] = False
    label = list(range(n))
    for a, b in zip(*(x.tolist() for x in met.nonzero()), strict=True):
        if label[a] != label[b]:
            out.append((a, b))
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    return out


def _possible(percent: int):
    """possible_pairs() of each group in rows sorted by block, x and y, as pairs of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def groups(table: pa.Table, last: bool) -> int:
            """Handle all groups that are whole; where the rest begins."""
            place = np.stack([np.asarray(table.column(k)) for k in (0, 1, 2)])
            edge = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            side, keys, sizes = (np.asarray(table.column(k)) for k in (3, 4, 5))
            sketches = table.column(6).to_pylist()
            for lo, hi in zip(edge[: None if last else -2], edge[1 : None if last else -1]):
                if hi - lo > 1:
                    left = None if place[1, lo] == place[2, lo] else int((side[lo:hi] == 0).sum())
                    out.extend((keys[lo + a], keys[lo + b]) for a, b in possible_pairs(sizes[lo:hi], sketches[lo:hi], percent, left))
            return edge[-2]

        def taken() -> pa.RecordBatch:
            rows = [pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            held = table.slice(groups(table, False))
            yield taken()
        if held is not None and held.num_rows:
            groups(held, True)
        yield taken()

    return run


def _close(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): spanning forests of the possible pairs within the blocks of members (block, class, n_shingles, sketch)."""
    size = F.greatest(F.ceil(F.count("*") / (4 * block)), F.ceil(F.sum(F.octet_length("sketch")) / _DIVISION_SKETCHES))
    dealt = _dealt(members, members.groupBy("block").agg(size.alias("divisions")))
    dealt = dealt.select("block", "x", "y", "side", "class", "n_shingles", "sketch")
    dealt = dealt.repartition(_tasks(members), "block", "x", "y").sortWithinPartitions("block", "x", "y", "side")
    return written(dealt.mapInArrow(_possible(percent), "a bigint, b bigint"), "close")


def _components(close: DataFrame) -> DataFrame:
    return connected_components(close).select(F.col("node").alias("class"), F.col("component").alias("block"))


def _differences(source: DataFrame, wanted: DataFrame, shingle: int, percent: int, division: int) -> DataFrame:
    """(block, class, copies, n, near, features) of the wanted classes: features is the difference from the block's reference."""
    whole = wanted.groupBy("block").agg(F.min("class").alias("reference"), F.ceil(F.sum("n_shingles") / division).alias("portions"))
    placed = wanted.join(whole, "block").withColumn("leads", F.col("class") == F.col("reference"))
    portion = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("portions") - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), F.col("portions"))))
    packed = source.mapInArrow(_packed(Filter(wanted).test()), "id bigint, text_hash bigint, packed binary")
    p, w = packed.alias("p"), placed.withColumn("portion", portion).alias("w")
    met = p.join(w, (F.col("p.text_hash") == F.col("w.text_hash")) & F.col("p.id").eqNullSafe(F.col("w.id"))).dropDuplicates(["class"])
    met = met.select("block", F.explode("portion").alias("portion"), "leads", "class", "copies", "packed")
    met = met.repartition(_tasks(source), "block", "portion").sortWithinPartitions("block", "portion", F.desc("leads"))
    return written(met.mapInArrow(_deltas(shingle, percent), _DELTA_DDL), "differences")


def _divisions(rows: DataFrame, block: int, division: int, name: str = "divisions") -> DataFrame:
    size = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("features")) / (8 * division)))
    return rows.groupBy("block").agg(size.alias(name))


def _linked(rows: DataFrame, percent: int, count_links: bool, block: int, division: int) -> DataFrame:
    """(a, b, links): a spanning forest of the links, and with count_links each class's number as (a, a, links)."""
    n, ddl = _tasks(rows), "a bigint, b bigint, links bigint"
    if count_links:
        dealt = _dealt(rows.select("block", "class", "copies", "n", "features"), _divisions(rows, block, division))
        return written(dealt.repartition(n, "block", "x", "y").groupBy("block", "x", "y").applyInArrow(_compare(percent), ddl), "links")
    # those near the reference are connected already: only the others are compared with all
    reference = rows.groupBy("block").agg(F.min("class").alias("reference"))
    star = rows.where("near").join(reference, "block").where("class <> reference")
    star = star.select(F.col("reference").alias("a"), F.col("class").alias("b"), F.lit(0).cast("long").alias("links"))
    apart = rows.where("not near")
    size = _divisions(apart, block, division, "xs").join(_divisions(rows, block, division, "ys"), "block")
    own = F.xxhash64("class")
    first = apart.join(size, "block").select("block", F.pmod(own, F.col("xs")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), F.lit(0).alias("side"), "class", "copies", "n", "features")
    second = rows.join(size, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), F.pmod(own, F.col("ys")).alias("y"), F.lit(1).alias("side"), "class", "copies", "n", "features")
    met = first.unionByName(second).repartition(n, "block", "x", "y").groupBy("block", "x", "y").applyInArrow(_compare(percent, between=True), ddl)
    return written(met.unionByName(star), "links")


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block: int = 512, division: int = DIVISION_FEATURES, count_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, n_shingles, class) of every document; (class, id, component, n_links) of every class, id being its smallest.

    Without count_links n_links only tells whether a class has any link or copy: it is 0 or more.
    """
    source = _input(docs, id_col, text_col)
    rows = written(source.mapInArrow(_set_rows(shingle), "id bigint, text_hash bigint, n_shingles bigint, class bigint, sketch binary, fine binary"), "sets")
    # of the smallest id, null last, and the smallest hash of the text: one document stands for the class
    stands = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash"))
    classes = rows.where("class is not null").groupBy("class").agg(stands.alias("s"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "sketch", "fine")))
    classes = written(classes.select("class", "s.id", "s.text_hash", "copies", "n_shingles", "sketch", "fine"), "classes")

    signed = source.mapInArrow(_signature_rows(shingle, percent, Filter(classes).test()), "sign bigint, class bigint")
    buckets = _buckets(signed)
    close = _close(buckets.join(classes.select("class", "n_shingles", "sketch"), "class"), percent, block)
    wanted = written(_components(close).join(classes, "class"), "wanted")
    large = wanted.groupBy("block").agg(F.max(F.col("fine").isNotNull()).alias("large"))
    wanted = wanted.join(large, "block")
    told = wanted.where("large").select("block", "class", "n_shingles", F.coalesce("fine", "sketch").alias("sketch"))
    apart = _components(_close(told, percent, block)).join(wanted.where("large").drop("block"), "class")
    wanted = written(wanted.where("not large").unionByName(apart).drop("sketch", "fine", "large"), "wanted")

    compared = _linked(_differences(source, wanted, shingle, percent, division), percent, count_links, block, division)

    reached = connected_components(compared.where("a <> b")).select(F.col("node").alias("class"), "component")
    if count_links:
        links = compared.where("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
        labelled = classes.join(reached, "class", "left").join(links, "class", "left")
    else:
        labelled = classes.join(reached.withColumn("links", F.lit(1).cast("long")), "class", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return rows, labelled.select("class", "id", F.coalesce("component", "class").alias("component"), n_links.alias("n_links"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block: int = 512, division: int = DIVISION_FEATURES) -> DataFrame:
    """One row per document: its id, n_shingles, component_id and n_links, the number of documents it links with."""
    rows, classes = classify(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent, block=block, division=division)
    classes = classes.join(classes.groupBy("component").agg(F.min("id").alias("component_id")), "component").drop("id")
    return rows.join(classes, "class", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block: int = 512, division: int = DIVISION_FEATURES) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id (a null id comes last).

    Documents without words all stay. Of rows with equal id and text in a component one stays. Documents
    that a filter shows to be neither dropped nor repeated are passed on where they are; only the
    others are joined, and so shuffled.
    """
    rows, classes = classify(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent, block=block, division=division, count_links=False)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")
    # read twice below: unwritten, what found the components would stand in that plan many times over, and the driver hold it
    linked = written(classes.where("n_links > 0").select("class", "component"), "linked")
    members = rows.join(linked, "class").select("component", order.alias("row"))
    keeper = members.groupBy("component").agg(F.min("row").alias("keeper"))
    gone = members.join(keeper, "component").where("row <> keeper").select("row.id", "row.text_hash", F.lit(True).alias("gone")).distinct()
    twice = rows.where("class is not null").groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "text_hash", F.lit(False).alias("gone"))
    asked = written(gone.unionByName(twice).groupBy("id", "text_hash").agg(F.max("gone").alias("gone")), "gone")
    doc, text_hash = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    marked = docs.select(*docs.columns, doc.alias("__id"), text_hash.alias("__hash"))
    marked = marked.withColumn("__maybe", Filter(asked).holds(F.col("__id"), F.col("__hash")))
    asked = asked.select(F.col("id").alias("__i"), F.col("text_hash").alias("__h"), F.col("gone").alias("__gone"))
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h"))
    met = marked.where("__maybe").join(asked, same, "left").where("__gone is null or not __gone")
    alone, again = met.where("__gone is null"), met.where("not __gone").dropDuplicates(["__id", "__hash"])
    out = marked.where("not __maybe").select(*docs.columns)
    return out.unionAll(alone.select(*docs.columns)).unionAll(again.select(*docs.columns))
