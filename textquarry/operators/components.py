"""Connected components of an edge list, by alternating large-star and small-star steps.

Edges are contracted to stars within each task first. Where one bounded task holds all that is left, those
stars are the components; otherwise the steps follow, each an aggregation (with map-side combine) and an
equi-join on the node, in which AQE splits the rows of a hub. Every round is written to the shared folder, so a lost executor never restarts the
iteration. Nothing is collected: only a count and a checksum of the edges come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.sources.shared import written


#: Edges that one task contracts in memory: some 100 MB of a Python worker.
TASK_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract a task's edges to stars around their smallest nodes, in portions of TASK_EDGES."""
    root: dict[int, int] = {}
    seen = 0

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    def stars() -> pa.RecordBatch:
        nodes = list(root)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["v", "m"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= TASK_EDGES:
            yield stars()
            root.clear()
            seen = 0
    yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
    least = both.groupBy("u").agg(F.min("w").alias("w")).select("u", F.least("u", "w").alias("m"))
    return both.where("w > u").join(least, "u").select(F.col("w").alias("v"), "m").where("v <> m")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge already points from the larger to the smaller node."""
    least = edges.groupBy("v").agg(F.min("m").alias("least"))
    across = edges.join(least, "v").where("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
    return across.unionAll(least.select("v", F.col("least").alias("m"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, loops: bool = True) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node reachable.

    Nodes are BIGINT. Edges with a null end are ignored; a loop alone makes its node a component, for which the
    edges are read a second time: without loops, which the caller vouches for, once.
    """
    pairs = edges.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("m")).where("v is not null and m is not null")
    now = written(pairs.where("v <> m").mapInArrow(_forest, "v bigint, m bigint").distinct(), "edges")
    n = now.count()
    # as few tasks as hold the edges; where one does, its stars are the components
    tasks = max(1, -(-n // (TASK_EDGES // 2)))
    now = written(now.coalesce(tasks).mapInArrow(_forest, "v bigint, m bigint"), "edges")
    before, state = None, _state(now) if tasks > 1 else None
    while state != before:
        now = written(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
    roots = now.select("v", "m").unionAll(now.select(F.col("m").alias("v"), "m"))
    if loops:
        roots = roots.unionAll(pairs.where("v = m").select("v", F.lit(None).cast("long").alias("m")))
    return roots.groupBy("v").agg(F.min("m").alias("m")).select(F.col("v").alias("node"), F.coalesce("m", "v").alias("component"))
