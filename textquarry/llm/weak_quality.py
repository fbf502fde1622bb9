"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over
the table of vote patterns (at most 3 to the number of labellers rows, counted over all documents)
estimates how accurate each labeller is and the posterior of every pattern, without any gold label. The
posteriors label a bounded sample, at most `most_rows` different texts with the smallest hashes, of which only votes
and hashed features (2**16 at most) reach the driver, where a linear scorer over them is fitted. The scorer then scores every document; it reads
what the labellers do not look at, so it also judges where they are silent.

Defined results
    null or empty text: all labellers silent, score from the intercept and the empty-text feature alone. Null or repeated ids:
    each row is scored; copies of a text are one row of the sample. Empty table: no rows. If all documents get the same votes, all get the prior's score.
    Other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.shingles import WordHashes

FEATURE_BITS = 16
_DROPPED = 64 - FEATURE_BITS
#: Frequent function words of English, French, Spanish and German.
FUNCTION_WORDS = frozenset(
    b"the of and to in is it for on with as was that by at be this are from or "
    b"le la les de des du et un une en que qui dans pour par sur au avec est pas "
    b"el los las del y se por con para como es lo su al una "
    b"der die das und zu den von mit sich ist im nicht ein eine auf dem".split()
)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?!")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_ASCII_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN, _BYTE_RUN = re.compile(r"(.)\1{3,}"), re.compile(rb"(.)\1{3,}")


def _vote(value: float, good: float, bad: float) -> int:
    """1 on the good side, -1 on the bad side, 0 between: good < bad means that small values are good."""
    if good < bad:
        return 1 if value <= good else -1 if value >= bad else 0
    return 1 if value >= good else -1 if value <= bad else 0


def votes(text: str | None) -> tuple[int, ...]:
    """The labellers' votes, in the order of LABELLERS."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.translate(_FOLD).split()
    n = len(words)
    if not n:
        return (0,) * len(LABELLERS)
    kinds = Counter(words)
    without = lambda chars: len(data) - len(data.translate(None, chars))
    capitals, small = without(_UPPER), without(_LOWER)
    lines = [x for x in text.split("\n") if x.strip()]
    grams = max(0, n - 2)
    return (
        _vote(without(_SYMBOLS) / len(data), 0.02, 0.06),
        _vote(capitals / (capitals + small), 0.25, 0.6) if capitals + small >= 20 else 0,
        _vote(sum(c for w, c in kinds.items() if w.strip(b".,;:!?\"'()") in FUNCTION_WORDS) / n, 0.15, 0.04) if n >= 8 else 0,
        _vote(1 - len(set(zip(words, words[1:], words[2:]))) / grams, 0.1, 0.35) if grams >= 10 else 0,
        _vote(sum(c for w, c in kinds.items() if w[-1] < 128 and w[-1:] not in b".,;:" and not w[-1:].isalnum()) / n, 0.05, 0.3),
        _vote(sum(kinds[w] for w in (b"|", b"-", b"*", b"#")) / n, 0.02, 0.15),
        _vote(abs(sum(map(len, words)) / n - 6), 3, 8) if n >= 8 else 0,
        _vote(1 - len(set(lines)) / len(lines), 0.1, 0.4) if len(lines) >= 4 else 0,
        (1 if sum(text.count(c) for c in ".!?") >= n / 60 else -1) if n >= 30 else 0,
        _vote(1 - len(kinds) / n, 0.7, 0.85) if 10 <= n <= 2000 else 0,
    )


#: Symbols, capitals, function words, repeated 3-grams, words that end in a symbol, lone marks, word length, repeated lines, sentence ends, repeated words.
LABELLERS = ("symbols", "capitals", "function_words", "repeated_grams", "odd_endings", "lone_marks", "word_length", "repeated_lines", "sentences", "repeated_words")


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """Posterior of good by pattern, accuracies (labeller, class) and the share of good, by expectation-maximisation.

    A labeller's votes given the class are independent of the others'; silence tells nothing. The
    start is the share of good votes, so the classes keep their names.
    """
    votes_, count = np.array(list(patterns), float), np.array(list(patterns.values()), float)
    said = votes_ != 0
    post = np.where(said.any(axis=1), ((votes_ > 0).sum(axis=1) + 0.5) / (said.sum(axis=1) + 1), 0.5)
    for _ in range(rounds):
        weight = np.stack([count * post, count * (1 - post)])
        up, all_ = weight @ (votes_ > 0), weight @ said
        # share of good votes in each class, held on the right side of one half
        share = (up + np.array([[2.0], [1.0]])) / (all_ + 3)
        share = np.clip(np.stack([np.maximum(share[0], share[1]), np.minimum(share[0], share[1])]), 1e-3, 1 - 1e-3)
        good = (weight[0].sum() + 1) / (count.sum() + 2)
        odds = np.log(good / (1 - good)) + (votes_ > 0) @ np.log(share[0] / share[1]) + (votes_ < 0) @ np.log((1 - share[0]) / (1 - share[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-9:
            break
    accuracy = np.stack([share[0], 1 - share[1]], axis=1)
    return dict(zip(patterns, post.tolist(), strict=True)), accuracy, float(good)


class _Shapes(dict):
    """code point -> what stands for it in a shape, for str.translate()."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        value = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return value


_SHAPES = _Shapes()


def _shape(word: bytes) -> bytes:
    """a for lower-case, A for capital letters, 0 for digits, the rest as it is; runs are cut to three."""
    if word.isascii():
        return _BYTE_RUN.sub(rb"\1\1\1", word.translate(_ASCII_SHAPE))
    text = word.decode("utf-8", "replace")
    return _RUN.sub(r"\1\1\1", text.translate(_SHAPES)).encode("utf-8", "replace")


class Features(dict):
    """word -> its hashed features: shape, ending, and the word if it is short."""

    def __init__(self):
        super().__init__()
        self.hashes = WordHashes()

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        own = b"word " + word.lower() if len(word) <= 5 else b"start " + word[:1]
        shape, end, own = self.hashes[b"shape " + _shape(word)], self.hashes[b"end " + word[-2:].lower()], self.hashes[own]
        value = self[word] = shape >> _DROPPED, end >> _DROPPED, own >> _DROPPED
        return value

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values, of length 1 together."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        counts = Counter(words)
        index = np.array(list(map(self.__getitem__, counts)), np.int64).reshape(-1)
        times = np.repeat(np.fromiter(counts.values(), float, len(counts)), 3)
        marks = []
        if len(words) > 4:
            twice = 1 - len(set(zip(words, words[1:]))) / (len(words) - 1)
            marks = [b"pairs %d" % int(twice * 8), b"kinds %d" % int(len(counts) / len(words) * 8)]
        extra = [self.hashes[m] >> _DROPPED for m in (*marks, b"any")]
        index, place = np.unique(np.append(index, extra), return_inverse=True)
        value = np.sqrt(np.bincount(place, np.append(times, [max(1, len(words))] * len(extra))))
        return index, value / np.sqrt((value**2).sum())


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights (the intercept last) for soft targets, by gradient descent with momentum."""
    size = (1 << FEATURE_BITS) + 1
    row = np.repeat(np.arange(len(rows)), [len(i) + 1 for i, _ in rows])
    col = np.concatenate([np.append(i, size - 1) for i, _ in rows])
    val = np.concatenate([np.append(v, 1.0) for _, v in rows])
    w, speed = np.zeros(size), np.zeros(size)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], len(rows)), -40, 40)))
        slope = np.bincount(col, val * (p - target)[row], size) / len(rows) + ridge * w
        speed = 0.9 * speed - rate * slope
        w += speed
    return w


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Features()
    for batch in batches:
        texts = [t.as_py() for t in batch.column(2)]
        said = ["".join("-0+"[v + 1] for v in votes(t)) for t in texts]
        found = [known.of(t) for t in texts]
        cols = [batch.column(0), batch.column(1), pa.array(said, pa.string()), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "hash", "votes", "index", "value"])


def fit(docs: DataFrame, *, text_col: str = "text", most_rows: int = 4000) -> np.ndarray:
    """Weights of the scorer."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = ["".join("-0+"[v + 1] for v in votes(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string())], names=["votes"])

    counted = texts.mapInArrow(vote, "votes string").groupBy("votes").agg(F.count("*").alias("n"))
    read = lambda s: tuple("-0+".index(c) - 1 for c in s)
    patterns = {read(r["votes"]): r["n"] for r in counted.toLocalIterator()}
    if not patterns:
        return np.zeros((1 << FEATURE_BITS) + 1)
    posterior, _, good = estimate(patterns)
    # a hash under a bound that lets somewhat more than most_rows different texts pass; those over it are cut off in hash order
    hashed = texts.withColumn("hash", F.xxhash64("text")).withColumn("key", F.pmod("hash", F.lit(1 << 30)))
    different = hashed.agg(F.approx_count_distinct("hash")).first()[0]
    share = min(1.0, 1.2 * most_rows / max(1, different))
    some = hashed.where(F.col("key") < int(share * (1 << 30)) + 1).dropDuplicates(["hash"]).select("key", "hash", "text")
    chosen = some.mapInArrow(_sampled, "key bigint, hash bigint, votes string, index binary, value binary").orderBy("key", "hash").limit(most_rows).toArrow()
    said = chosen.column("votes").to_pylist()
    rows = [(np.frombuffer(i, np.int64), np.frombuffer(v, np.float64)) for i, v in zip(chosen.column("index").to_pylist(), chosen.column("value").to_pylist(), strict=True)]
    target = np.array([posterior.get(read(s), good) for s in said])
    if len(rows) < 2 or target.max() - target.min() < 1e-6:
        w = np.zeros((1 << FEATURE_BITS) + 1)
        w[-1] = np.log(good / (1 - good))
        return w
    return fit_scorer(rows, target)


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None, most_rows: int = 4000) -> DataFrame:
    """(id, score) of every document: the higher, the better."""
    w = fit(docs, text_col=text_col, most_rows=most_rows) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = Features(), shared.value
        for batch in batches:
            margin = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(1)):
                index, value = known.of(text.as_py())
                margin[k] = w[index] @ value + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40))))], names=[batch.schema.names[0], "score"])

    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return df.mapInArrow(run, f"`{id_col}` {df.schema[0].dataType.simpleString()}, score double")
