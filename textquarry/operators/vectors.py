"""Cosine search over embedding arrays.

Queries are broadcast in blocks of a fixed number of values; every task multiplies its Arrow batches with a
block and keeps the k best per query, so at most k rows a task and query are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A block of queries has at most so many numbers: 32 MB.
BLOCK_VALUES = 4 << 20
MAX_K = 64


def fit_length(vector: Column, dim: int) -> Column:
    """Cut to dim values, or filled up with zeros."""
    cut = F.slice(vector, 1, dim)
    return F.concat(cut, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(cut), F.lit(0))))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(vector: Column) -> Column:
    """Of length 1; a vector of zeros stays."""
    scaled = lambda v: F.transform(v["v"], lambda x: F.when(v["n"] > 0, x.cast("double") / v["n"]).otherwise(0.0).cast("float"))
    return F.element_at(F.transform(F.array(F.struct(vector.alias("v"), norm(vector).alias("n"))), scaled), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def percent(score: Column) -> Column:
    return F.format_string("%.0f%%", score * 100)


def _matrix(column: pa.Array, dim: int, single: bool = False) -> np.ndarray:
    """Rows of length dim and norm 1, in 64 bits; nulls are zeros. single: rounded to 32 bits each, as normalize() stores them."""
    out = np.zeros((len(column), dim))
    for k, v in enumerate(column.to_pylist()):
        if v is not None:
            v = [0.0 if x is None else x for x in v[:dim]]
            out[k, : len(v)] = v
    # squares are added up one after the other as in norm(): the last bit of a length can move a value's 32nd
    length = np.sqrt(np.add.accumulate(out * out, axis=1)[:, -1:] if single else (out * out).sum(axis=1, keepdims=True))
    np.divide(out, length, out=out, where=length > 0)
    return out.astype(np.float32).astype(np.float64) if single else out


def _blocks(corpus: DataFrame, queries: DataFrame, id_col: str, vector_col: str, single: bool = False) -> Iterator[tuple]:
    """(broadcast of ids and matrix, length of vectors) for each block of queries; a block has BLOCK_VALUES numbers at most."""
    dim = corpus.select(F.max(F.size(vector_col))).first()[0] or 1
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    blocks = max(1, -(-asked.count() * dim // BLOCK_VALUES))
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        table = part.toArrow()
        ids = np.asarray(table.column("id").to_numpy(), np.int64)
        yield corpus.sparkSession.sparkContext.broadcast((ids, _matrix(table.column("v").combine_chunks(), dim, single))), dim


def _over_blocks(corpus: DataFrame, queries: DataFrame, id_col: str, vector_col: str, make, single: bool = False) -> DataFrame:
    rows, found = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), None
    for shared, dim in _blocks(corpus, queries, id_col, vector_col, single):
        part = rows.mapInArrow(make(shared, dim), "query_id bigint, id bigint, score double")
        found = part if found is None else found.unionAll(part)
    return found


def cosine_scores(corpus: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score) of every row for every query, block by block of queries.

    Vectors are normalised and stored in 32 bits first, as by normalize(); the products are added up in 64 bits.
    """

    def make(shared, dim: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, matrix = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    scores = (_matrix(part.column(1), dim, single=True) @ matrix.T).ravel()
                    own = np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(queries))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(queries, part.num_rows)), pa.array(own), pa.array(scores)], names=["query_id", "id", "score"])

        return run

    return _over_blocks(corpus, queries, id_col, vector_col, make, single=True).withColumnRenamed("id", id_col)


def knn(corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = True, digits: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest by cosine; ties go to the smaller id.

    With skip_self the query itself is asked for too and then left out, so at most MAX_K - 1 others remain.
    digits: round scores before ranking.
    """
    k = max(0, min(k, MAX_K - 1 if skip_self else MAX_K))
    found = _over_blocks(corpus, queries, id_col, vector_col, lambda shared, dim: _nearest(shared, k, dim, skip_self, digits))
    over = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _nearest(shared, k: int, dim: int, skip_self: bool, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, matrix = shared.value
        ids, scores = np.empty((len(queries), 0), np.int64), np.empty((len(queries), 0))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                own = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                new = matrix @ _matrix(part.column(1), dim).T
                new = new if digits is None else np.round(new, digits) + 0.0
                if skip_self:
                    new[queries[:, None] == own[None, :]] = -np.inf
                ids, scores = np.hstack([ids, np.broadcast_to(own, new.shape)]), np.hstack([scores, new])
                order = np.lexsort((ids, -scores))[:, :k]
                ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        real = np.isfinite(scores)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(queries[:, None], ids.shape)[real]), pa.array(ids[real]), pa.array(scores[real])], names=["query_id", "id", "score"])

    return run
