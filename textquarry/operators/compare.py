"""Comparison of two results row by row, as when one operator is run by two paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.simhash import hamming


def _beside(left: DataFrame, right: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """(keys, in_l, l, in_r, r) of every key of either side; null keys meet one another. A key that is twice on a side counts twice."""
    side = lambda df, name: df.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.lit(True).alias(f"in_{name}"), F.col(value_col).alias(name))
    on = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys]
    return side(left, "l").join(side(right, "r"), on, "full")


def _counts():
    both = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    return [F.count("*").alias("n"), F.count_if(~both).alias("n_unmatched"), F.count_if(both & ~F.col("l").eqNullSafe(F.col("r"))).alias("n_different")]


def compare(left: DataFrame, right: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """One row: keys of either side, keys of one side only, keys whose values differ, and the largest difference (null if no key is on both)."""
    delta = F.abs(F.col("l").cast("double") - F.col("r").cast("double"))
    return _beside(left, right, keys, value_col).agg(*_counts(), F.max(delta).alias("max_delta"))


def compare_hashes(left: DataFrame, right: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """As compare() for hashes of 64 bits, with the mean number of bits that differ."""
    return _beside(left, right, keys, hash_col).agg(*_counts(), F.avg(hamming(F.col("l"), F.col("r"))).alias("mean_bits"))


def same_order(left: DataFrame, right: DataFrame, query_col: str, rank_col: str, id_col: str) -> DataFrame:
    """(query, n_left, n_right, same): whether both sides name the same ids in the same order. Of a top k, so a query's rows are few."""
    ids = lambda df, name: df.groupBy(query_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank_col, id_col))), lambda x: x[id_col]).alias(name))
    met = ids(left, "l").join(ids(right, "r"), query_col, "full")
    return met.select(query_col, *(F.coalesce(F.size(c), F.lit(0)).alias(f"n_{n}") for c, n in (("l", "left"), ("r", "right"))), F.col("l").eqNullSafe(F.col("r")).alias("same"))
