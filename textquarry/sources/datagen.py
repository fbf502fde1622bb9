"""Seeded generators, spread over the cluster: each row has a seed of its own, so any partitioning gives the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
_CONSONANTS, _VOWELS = "bcdfglmnprstv", "aeiou"


class Mulberry32:
    """The 32-bit generator of that name: numbers from 0 to 1."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & _MASK
        t = self.state
        t = ((t ^ t >> 15) * (t | 1)) & _MASK
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & _MASK)) & _MASK
        return ((t ^ t >> 14) & _MASK) / 4294967296


def word(n: int) -> str:
    """The n-th word of an endless list, made of syllables."""
    out = ""
    while True:
        n, k = divmod(n, len(_CONSONANTS) * len(_VOWELS))
        out += _CONSONANTS[k % len(_CONSONANTS)] + _VOWELS[k // len(_CONSONANTS)]
        if not n:
            return out
        n -= 1


def _words(rng: Mulberry32, n: int, pool: int) -> list[str]:
    """Frequent words first: the square of a uniform number picks."""
    return [word(int(rng() ** 2 * pool)) for _ in range(n)]


def _rows(spark: SparkSession, n: int, make, ddl: str) -> DataFrame:
    def run(frames):
        for frame in frames:
            yield pd.DataFrame([make(int(i)) for i in frame["id"]], columns=[f.split()[0] for f in ddl.split(", ")])

    return spark.range(n).mapInPandas(run, ddl)


def text_corpus(spark: SparkSession, size: int, seed: int = 0x9E3779B1) -> DataFrame:
    """(doc_id, label, text): titles of 3-5 words, texts of 15-39 more; a pool of at most 18,000 words."""
    pool = min(2000 + size, 18000)

    def make(i):
        rng = Mulberry32(seed ^ size ^ i * 2654435761)
        title = _words(rng, 3 + int(rng() * 3), pool)
        return i, " ".join(title), " ".join(title + _words(rng, 15 + int(rng() * 25), pool))

    return _rows(spark, size, make, "doc_id bigint, label string, text string")


def document(seed: int, words: int, pool: int = 3000) -> str:
    rng = Mulberry32(seed)
    return "".join(w + (".\n" if rng() < 0.08 else " ") for w in _words(rng, words, pool)).strip()


def near_duplicates(spark: SparkSession, count: int, seed: int = 0xC0FFEE) -> DataFrame:
    """(doc_id, text): 120-199 words; every seventh row is the one before it with three words changed."""

    def make(i):
        base = i - 1 if i and i % 7 == 0 else i
        rng = Mulberry32(seed ^ count ^ base * 40503)
        words = _words(rng, 120 + int(rng() * 80), 3000)
        if base != i:
            edit = Mulberry32(seed ^ i)
            for _ in range(3):
                words[int(edit() * len(words))] = word(int(edit() * 3000))
        return i, " ".join(words)

    return _rows(spark, count, make, "doc_id bigint, text string")


def clustered_embeddings(spark: SparkSession, count: int, dim: int = 384, centres: int = 12, jitter: float = 0.35, seed: int = 0xC0FFEE) -> DataFrame:
    """(vec_id, embedding): around 12 centres, of length 1."""

    def make(i):
        rng, near = Mulberry32(seed ^ count ^ i * 2246822519), Mulberry32(seed + i % centres)
        v = np.array([near() * 2 - 1 + (rng() * 2 - 1) * jitter for _ in range(dim)])
        return i, (v / np.linalg.norm(v)).tolist()

    return _rows(spark, count, make, "vec_id bigint, embedding array<float>")


def gray_image(seed: int, side: int = 32) -> np.ndarray:
    """Waves and noise, 0 to 255."""
    rng = Mulberry32(seed)
    y, x = np.mgrid[0:side, 0:side]
    image = np.zeros((side, side))
    for _ in range(4):
        fx, fy, phase, weight = rng() * 0.6, rng() * 0.6, rng() * 6.28, 20 + rng() * 30
        image += weight * np.sin(fx * x + fy * y + phase)
    noise = np.array([rng() for _ in range(side * side)]).reshape(side, side)
    return np.clip(128 + image + (noise - 0.5) * 12, 0, 255).astype(np.float32).ravel()


def gray_library(spark: SparkSession, count: int, seed: int = 0xF00D) -> DataFrame:
    """(img_id, gray, source): about one in a hundred is another image, its source, with noise of 1.5."""

    def make(i):
        if i and i % 97 == 0:
            rng = Mulberry32(seed ^ i)
            image = gray_image((seed ^ count) + (i - 1) * 7919) + np.array([(rng() * 2 - 1) * 1.5 for _ in range(1024)], np.float32)
            return i, np.clip(image, 0, 255).tolist(), i - 1
        return i, gray_image((seed ^ count) + i * 7919).tolist(), None

    return _rows(spark, count, make, "img_id bigint, gray array<float>, source bigint").withColumn("source", F.col("source").cast("long"))


def rgba_images(spark: SparkSession, count: int, side: int, seed: int = 0xA11CE) -> DataFrame:
    """(img_id, width, height, data): gradients with blocks and some noise, opaque."""

    def make(i):
        rng = Mulberry32(seed ^ side ^ i * 97)
        y, x = np.mgrid[0:side, 0:side]
        planes = [(x * (1 + int(rng() * 5)) + y * (1 + int(rng() * 3)) + int(rng() * 40)) // 8 * 8 % 256 for _ in range(3)]
        noise = np.array([rng() for _ in range(side)])
        planes[0] = np.where(noise[None, :] < 0.05, 255, planes[0])
        image = np.dstack([*planes, np.full((side, side), 255)]).astype(np.uint8)
        return i, side, side, image.tobytes()

    return _rows(spark, count, make, "img_id bigint, width int, height int, data binary")


#: Of so many page images the last is a near copy of the one before it.
COPY_EVERY = 7


def page_grays(pages: DataFrame, side: int = 32) -> DataFrame:
    """(img_id, gray, source): a picture for each page from its id alone; every COPY_EVERY-th is its source, the one before it, with noise of 1."""
    i = F.col("page_id")
    copy = i % COPY_EVERY == COPY_EVERY - 1
    rows = pages.select(i.alias("img_id"), F.when(copy, i - 1).alias("source"), F.when(copy, i - 1).otherwise(i).alias("b"))
    b = F.col("b")

    def pixel(k):
        x, y = k % side, F.floor(k / side)
        wave = x * (1 + b % 7) + y * (1 + b % 5) + (x * y * (1 + b % 11)) % 37 + ((x + b) * (y + 3 * b)) % (29 + b % 13)
        noise = F.when(F.col("source").isNull(), 0).otherwise((k * 5 + F.col("img_id")) % 3 - 1)
        return F.greatest(wave % 256 + noise, F.lit(0)).cast("float")

    return rows.select("img_id", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), pixel).alias("gray"), "source")


def page_rgba(pages: DataFrame, side: int = 32) -> DataFrame:
    """(img_id, width, height, data): opaque steps of colour for each page from its id alone."""
    i = F.col("page_id")

    def channel(k):
        c, x, y = k % 4, F.floor(k / 4) % side, F.floor(k / (4 * side))
        step = F.floor((x * (1 + i % 5) + y * (1 + i % 3) + 40 * c + i) / 8) * 8 % 256
        return F.lpad(F.hex(F.when(c == 3, 255).otherwise(step)), 2, "0")

    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4 * side * side - 1)), channel), ""))
    return pages.select(i.alias("img_id"), F.lit(side).alias("width"), F.lit(side).alias("height"), data.alias("data"))


def event_streams(conversations: DataFrame, size: int = 40) -> DataFrame:
    """(stream_id, seq, chunk): the assistant texts of each conversation as server-sent events cut every `size` characters."""
    line = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n"))
    said = conversations.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    raw = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: line(x["text"])), "").alias("raw"))
    raw = raw.withColumn("raw", F.concat("raw", F.lit("data: [DONE]\n")))
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), ((F.length("raw") - 1) / size).cast("int")), lambda k: F.substr("raw", k * size + 1, F.lit(size))))
    return raw.select(F.col("conv_id").alias("stream_id"), cut.alias("seq", "chunk"))
