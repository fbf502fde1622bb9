"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds.

Ordinary text and toxic text each train a dictionary. A text is cut into windows of 64 bytes, and every
window is compressed with the ordinary dictionary alone and with the toxic one before it; the bytes
that the toxic dictionary saves are the window's distance. A document's score is a logistic function of
how many of its windows save at least so many bytes, whose weights and threshold are calibrated on
each half of the labelled documents with dictionaries trained on the other half.

Most of a toxic document is ordinary. So the toxic dictionary is trained on what sets toxic text apart:
stretches made of 5-byte strings and beginnings of words (up to 9 bytes with the blank) that are at least
`contrast` times as frequent among the words of toxic documents as among those of ordinary ones. Every
document counts each of its different words once: a stem that ordinary text knows too still tells when toxic
text is full of it, and a repeated line counts no more than one. The ordinary dictionary is trained on
windows without such stretches. In the ordinary compressor random bytes stand where the other has the
toxic dictionary: both have dictionaries of one size, and so the same search parameters and offsets.

The model is fitted on a bounded sample of labelled rows: at most 4 * `most_toxic` toxic and as many
ordinary documents, those with the smallest hash of their id; of the ordinary ones at most `most_windows`
windows train the dictionary. Everything else runs over all documents
and whole texts.

Defined results
    null or empty text: one empty window, so the score of a document that shows nothing. Without
    labels of both kinds the score is the share of toxic labels, (n + 1) / (N + 2), for all. Null ids: scored;
    held_out is null. Repeated rows: each is scored. Labels: null ids or values are ignored, of several
    the largest counts. Empty table: no rows. Other columns are neither read nor returned by
    score_documents(); drop_toxic() returns all columns of its input.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import itertools
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 64
_GRAM = 5
#: Lengths of the beginnings of words, with the blank, that count besides the 5-byte strings.
_STARTS = range(_GRAM + 1, 10)
_LEVEL = 3
#: A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 4 << 20


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] | None
    prior: float


@functools.lru_cache(maxsize=2)
def _compressors(model: Model):
    pad = random.Random(1).randbytes(len(model.toxic))
    out = []
    for content in (pad + model.ordinary, model.toxic + model.ordinary):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=_LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=_LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _sizes(compressor, data: bytes, segments: np.ndarray) -> np.ndarray:
    found = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()), threads=0)
    return np.fromiter(map(len, found), np.int64, len(segments))


def _saved(model: Model, texts: list[bytes]) -> list[np.ndarray]:
    """Bytes saved in each window of each text."""
    ordinary, toxic = _compressors(model)
    counts = [max(1, -(-len(t) // WINDOW)) for t in texts]
    out, segments, at = [], [], 0
    for text, n in zip(texts, counts, strict=True):
        start = np.arange(n) * WINDOW
        segments.append(np.stack([start + at, np.clip(len(text) - start, 0, WINDOW)], axis=1))
        at += len(text)
    flat = np.concatenate(segments).astype(np.uint64)
    filled = flat[:, 1] > 0
    saved = np.zeros(len(flat), np.int64)
    if filled.any():
        data = b"".join(texts)
        saved[filled] = _sizes(ordinary, data, flat[filled]) - _sizes(toxic, data, flat[filled])
    edge = np.cumsum([0, *counts])
    for k in range(len(texts)):
        out.append(saved[edge[k] : edge[k + 1]])
    return out


def _features(saved: np.ndarray) -> list[float]:
    top = np.sort(saved)[::-1][:3]
    shares = [float((saved >= t).mean()) for t in (2, 3, 4, 5)]
    return [min(float(top[0]), 12.0), min(float(top.mean()), 10.0), float(saved.mean()), *shares, float(np.log1p((saved >= 3).sum())), float(np.log1p(len(saved)))]


def features(model: Model, texts: list[str | None]) -> np.ndarray:
    out, group, size = [], [], 0
    for text in map(fold, texts):
        group.append(text)
        size += len(text)
        if size >= _CHUNK:
            out += map(_features, _saved(model, group))
            group, size = [], 0
    if group:
        out += map(_features, _saved(model, group))
    return np.array(out, float).reshape(len(texts), -1)


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.weights is None or not texts:
        return np.full(len(texts), model.prior)
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(features(model, texts) @ w[:-1] + w[-1], -40, 40)))


# ---- fitting ----------------------------------------------------------------------------------------


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word
    return {word[i : i + _GRAM] for i in range(max(1, len(word) - _GRAM + 1))} | {word[:n] for n in _STARTS if n <= len(word)}


def _occurrences(texts: list[bytes], among: set[bytes] | None = None) -> tuple[Counter, int]:
    """In how many words each string occurs, and the number of words; a text counts each of its different words once."""
    words = Counter(w for t in texts for w in set(t.split()))
    counts = Counter()
    for word, n in words.items():
        for g in _grams(word):
            if among is None or g in among:
                counts[g] += n
    return counts, sum(words.values())


def _telling(toxic: list[bytes], ordinary: list[bytes], contrast: float, least_share: float) -> set[bytes]:
    least = max(4, least_share * len(toxic))
    counts, n_toxic = _occurrences(toxic)
    often = {g for g, n in counts.items() if n >= least}
    docs = Counter(g for t in toxic for g in often.intersection(set().union(*map(_grams, set(t.split())))))
    often = {g for g in often if docs[g] >= least}
    other, n_ordinary = _occurrences(ordinary, often)
    return {g for g in often if counts[g] * n_ordinary >= contrast * (other[g] + 1) * n_toxic}


def _stretches(text: bytes, telling: set[bytes]) -> bytes:
    out = []
    for word in text.split():
        word = b" " + word
        end = max((n for n in _STARTS if n <= len(word) and word[:n] in telling), default=0)
        out.append(word[:end])
        for i in range(max(1, len(word) - _GRAM + 1)):
            if i + _GRAM > end and word[i : i + _GRAM] in telling:
                out.append(word[max(i, end) : i + _GRAM])
                end = i + _GRAM
    return b"".join(out)


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights by Newton's method, the intercept last."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, damp = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge * len(x) / 10
    damp[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + damp + 1e-9 * np.eye(len(w)), z.T @ (y - p) - damp @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] /= scale
    w[-1] -= mean @ w[:-1]
    return w


def _best_threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin at which F1 is largest."""
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    after = margin[order[k + 1]] if k + 1 < len(y) else margin[order[k]] - 1
    return float((margin[order[k]] + after) / 2)


def fit(texts: list[str | None], toxic: list[int], *, contrast: float = 12.0, least_share: float = 0.004, ordinary_size: int = 32768, toxic_size: int = 2048, most_windows: int = 51_200) -> Model:
    """Two dictionaries; calibration on each half with dictionaries from the other. Copies count once.

    The toxic dictionary is trained on all toxic texts, the ordinary one on at most `most_windows` windows drawn
    at random from all ordinary texts.
    """
    rows = {}
    for text, label in zip(texts, toxic, strict=True):
        rows.setdefault(fold(text), label)
    prior = (sum(toxic) + 1) / (len(toxic) + 2)
    half = {t: hashlib.blake2b(t, digest_size=1).digest()[0] % 2 for t in rows}

    def trained(of: tuple[int, ...]) -> Model | None:
        bad, good = ([t for t, y in rows.items() if half[t] in of and bool(y) == kind] for kind in (True, False))
        if not bad or not good:
            return None
        telling = _telling(bad, good, contrast, least_share)
        windows = [t[i : i + WINDOW] for t in good for i in range(0, len(t), WINDOW)]
        random.Random(2).shuffle(windows)
        plain = itertools.islice((w for w in windows if not _stretches(w, telling)), most_windows)
        return Model(_dictionary(ordinary_size, list(plain)), _dictionary(toxic_size, [_stretches(t, telling) for t in bad]), None, prior)

    x, y = [], []
    for k in (0, 1):
        check = [(t, v) for t, v in rows.items() if half[t] == k]
        if not check or (model := trained((1 - k,))) is None:
            return Model(b"", b"", None, prior)
        x.append(features(model, [t.decode("utf-8", "surrogatepass") for t, _ in check]))
        y += [float(bool(v)) for _, v in check]
    x, y = np.concatenate(x), np.array(y)
    w = _logistic(x, y)
    w[-1] -= _best_threshold(x @ w[:-1] + w[-1], y)
    model = trained((0, 1))
    return Model(model.ordinary, model.toxic, tuple(w.tolist()), prior)


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 marks the held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit_on_labels(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 1000, **options) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    marks = marks.groupBy("i").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y")).where(remainder("i") != 0)
    order = F.xxhash64(F.col("i"))
    chosen = marks.where("y = 1").orderBy(order).limit(4 * most_toxic).unionAll(marks.where("y = 0").orderBy(order).limit(4 * most_toxic))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "i")
    rows = texts.select("t", "y").toArrow()
    rows = sorted(zip(rows.column("t").to_pylist(), rows.column("y").to_pylist(), strict=True), key=lambda r: (r[0] or "", r[1]))
    model = fit([t for t, _ in rows], [y for _, y in rows], **options)
    del rows
    _give_back()
    return model


def _give_back() -> None:
    """Return what the C library holds of freed memory: else the driver has the peak of a fit for the rest of the session."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(shared.value, batch.column(1).slice(lo, 500).to_pylist()) for lo in range(0, batch.num_rows, 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else [], pa.float64())], names=[batch.schema.names[0], "score"])

    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return df.mapInArrow(run, f"`{id_col}` {df.schema[0].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what Arrow holds of the worker's last task
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # a copy of a whole batch would be held here and once more by the JVM
                some = batch.slice(lo, 500)
                yield some.filter(pa.array(scores(shared.value, some.column(at).to_pylist()) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
