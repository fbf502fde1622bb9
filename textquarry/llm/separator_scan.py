"""Token counts of flat, unindexed token files by a separator scan.

A flat token file is a sequence of little-endian unsigned 32-bit ids, documents one after another, each
closed by the end-of-document id; there is no index. It is read in blocks of bytes. numpy searches each
block for the id; blocks know nothing of one another, so documents are stitched together across blocks
by a prefix scan of the blocks' last separators: over groups of blocks first, then within each group, so
that a file that holds a third of all tokens needs no task of its own.

Defined results
    n_tokens does not count the separator. Tokens after a file's last separator are a document that is
    not closed (closed = false). A file of no tokens has no documents. A null or empty text is written
    as a document of no tokens. The end-of-text string within a text is ordinary text: all its tokens count, and
    none is the separator. An end_id that texts can produce is refused when they are written. Blocks may come in any order and any partitioning; a block's length must
    be a multiple of four bytes. Repeated or null ids: each row is a document of its own. Other columns
    are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm import tokens
from textquarry.sources.shared import written


def write_flat(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_OF_TEXT_ID, block_tokens: int = 1 << 18, ranks_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokenise documents into one flat stream per task: blocks (file, block, ids) and the order (file, nth, id).

    Blocks are cut without regard to documents, as reads of a flat file are.
    """
    path = ranks_path or tokens.tokenizer_path("byte_bpe_50k.tiktoken")
    if not 0 <= end_id < 1 << 32 or tokens.is_ordinary(tokens.load(path), end_id):
        raise ValueError(f"end_id {end_id} is an id of ordinary text, or none of 32 bits")
    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = df.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = tokens.load(path), TaskContext.get().partitionId()
        held, n_held, block, nth, id_type = [], 0, 0, 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 1000):
                some, blocks = batch.slice(lo, 1000), []
                for text in some.column(1):
                    ids = tokens.encode_ordinary(encoder, text.as_py())
                    held.append(np.append(ids, np.uint32(end_id)).astype("<u4"))
                    n_held += len(held[-1])
                    if n_held >= block_tokens:
                        flat = np.concatenate(held)
                        for at in range(0, n_held - block_tokens + 1, block_tokens):
                            blocks.append((block, flat[at : at + block_tokens].tobytes()))
                            block += 1
                        held = [flat[n_held - n_held % block_tokens :]] if n_held % block_tokens else []
                        n_held %= block_tokens
                yield _rows(file, blocks, some.column(0), nth, id_type)
                nth += some.num_rows
        if n_held:
            yield _rows(file, [(block, np.concatenate(held).tobytes())], None, nth, id_type)

    def _rows(file, blocks, ids, nth, id_type):
        n, m = len(blocks), 0 if ids is None else len(ids)
        cols = [
            pa.array([file] * (n + m), pa.int32()),
            pa.array([b for b, _ in blocks] + [None] * m, pa.int64()),
            pa.array([x for _, x in blocks] + [None] * m, pa.binary()),
            pa.array([None] * n + list(range(nth, nth + m)), pa.int64()),
            pa.concat_arrays([pa.nulls(n, id_type), ids]) if m else pa.nulls(n, id_type),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["file", "block", "ids", "nth", id_col])

    out = written(df.mapInArrow(run, f"file int, block bigint, ids binary, nth bigint, `{id_col}` {kind}"), "flat")
    file = F.col("file").cast("string").alias("file")
    return out.where("block is not null").select(file, "block", "ids"), out.where("nth is not null").select(file, "nth", id_col)


def read_flat(spark: SparkSession, path: str, *, block_tokens: int = 1 << 18) -> DataFrame:
    """Blocks (file, block, ids) of the flat files under a path, read by Spark; files up to 2 GB each."""
    step = 4 * block_tokens
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), ((F.col("length") - 1) / step).cast("long")), lambda k: F.substring("content", (k * step + 1).cast("int"), F.lit(step))))
    return files.select(F.col("path").alias("file"), cut.alias("block", "ids")).withColumn("block", F.col("block").cast("long"))


def _search(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = [], []
            for ids in batch.column(2):
                flat = np.frombuffer(ids.as_buffer() if ids.is_valid else b"", "<u4")
                size.append(len(flat))
                at.append(np.flatnonzero(flat == end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(at, pa.list_(pa.int64()))], names=["file", "block", "size", "at"])

    return run


def scan(blocks: DataFrame, *, end_id: int = tokens.END_OF_TEXT_ID, group: int = 1024) -> DataFrame:
    """(file, nth, start, n_tokens, closed) of every document in the blocks."""
    found = blocks.select("file", "block", "ids").mapInArrow(_search(end_id), "file string, block bigint, size bigint, at array<bigint>")
    found = written(found.withColumn("grp", F.floor(F.col("block") / group)), "separators")
    # Of each block: its tokens, its separators, and where its last separator ends, from its own start.
    each = found.select("file", "grp", "block", "size", "at", F.size("at").cast("long").alias("n"), (F.try_element_at("at", F.lit(-1)) + 1).alias("last"))
    in_group = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("base", F.coalesce(F.sum("size").over(in_group), F.lit(0)))
    each = each.withColumn("seen", F.coalesce(F.sum("n").over(in_group), F.lit(0)))
    each = each.withColumn("open", F.last(F.col("base") + F.col("last"), ignorenulls=True).over(in_group))
    groups = each.groupBy("file", "grp").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(F.col("base") + F.col("last")).alias("last"))
    over = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("g_base", F.coalesce(F.sum("size").over(over), F.lit(0))).withColumn("g_seen", F.coalesce(F.sum("n").over(over), F.lit(0)))
    groups = groups.withColumn("g_open", F.coalesce(F.last(F.col("g_base") + F.col("last"), ignorenulls=True).over(over), F.lit(0)))
    ends = groups.groupBy("file").agg(F.sum("size").alias("total"), F.sum("n").alias("docs"), F.coalesce(F.max(F.col("g_base") + F.col("last")), F.lit(0)).alias("open"))
    carried = each.where("n > 0").join(groups.select("file", "grp", "g_base", "g_seen", "g_open"), ["file", "grp"])
    carried = carried.select("file", (F.col("g_base") + F.col("base")).alias("from"), (F.col("g_seen") + F.col("seen")).alias("first"), F.coalesce(F.col("g_base") + F.col("open"), F.col("g_open")).alias("open"), "at")
    start = F.concat(F.array("open"), F.transform(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda x: x + F.col("from") + 1))
    rows = carried.select("file", "first", "from", F.posexplode(F.arrays_zip(start.alias("start"), F.col("at").alias("end"))).alias("k", "d"))
    closed = rows.select("file", (F.col("first") + F.col("k")).alias("nth"), F.col("d.start").alias("start"), (F.col("d.end") + F.col("from") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = ends.where("open < total").select("file", F.col("docs").alias("nth"), F.col("open").alias("start"), (F.col("total") - F.col("open")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_OF_TEXT_ID, block_tokens: int = 1 << 18, group: int = 1024) -> DataFrame:
    """Write the documents flat, scan the files, and give each count its document: id, file, nth, start, n_tokens."""
    blocks, order = write_flat(docs, id_col=id_col, text_col=text_col, end_id=end_id, block_tokens=block_tokens)
    return order.join(scan(blocks, end_id=end_id, group=group), ["file", "nth"]).select(id_col, "file", "nth", "start", "n_tokens")
