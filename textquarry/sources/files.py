"""Readers of site indexes, document lists, embeddings and images; writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import or_else
from textquarry.operators.vectors import fit_length, normalize

#: Fields of a site index.
INDEX_FIELDS = ("title", "description", "content", "author", "place", "path", "url")


def read_site_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array, or of {"data": [...]}; fields that are missing are null; without rows an empty table."""
    raw = spark.read.option("multiLine", True).schema("data array<struct<" + ",".join(f"`{f}`:string" for f in INDEX_FIELDS) + ">>, " + ", ".join(f"`{f}` string" for f in INDEX_FIELDS)).json(path)
    wrapped = raw.where("data is not null").select(F.explode("data").alias("r")).select("r.*")
    plain = raw.where("data is null").select(*INDEX_FIELDS).where(" or ".join(f"`{f}` is not null" for f in INDEX_FIELDS))
    return wrapped.unionByName(plain)


def read_document_list(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, url, text) of {"docs": [...]}; a missing title is "Document n"."""
    raw = spark.read.option("multiLine", True).schema("docs array<struct<title:string,url:string,text:string>>").json(path)
    rows = raw.select(F.posexplode("docs").alias("i", "d"))
    title = or_else(F.trim("d.title"), F.concat(F.lit("Document "), (F.col("i") + 1).cast("string")))
    return rows.select(F.col("i").cast("long").alias("doc_id"), title.alias("title"), F.coalesce("d.url", F.lit("")).alias("url"), F.coalesce("d.text", F.lit("")).alias("text"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, title, url, embedding) of {"dim": n, "docs": [...]}: of one length, that of dim or of the first, and norm 1."""
    raw = spark.read.option("multiLine", True).schema("dim int, docs array<struct<title:string,url:string,embedding:array<float>>>").json(path)
    rows = raw.select(F.coalesce("dim", F.size(F.element_at("docs", 1)["embedding"])).alias("dim"), F.posexplode("docs").alias("i", "d"))
    return rows.select(F.col("i").cast("long").alias("vec_id"), "d.title", "d.url", normalize(_fit("d.embedding", "dim")).alias("embedding"))


def _fit(vector: str, dim: str) -> Column:
    cut = F.slice(F.coalesce(F.col(vector), F.array().cast("array<float>")), F.lit(1), F.col(dim))
    return F.concat(cut, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.col(dim) - F.size(cut), F.lit(0))))


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """(img_id, url, title) of {"images": [...]}, without empty addresses."""
    raw = spark.read.option("multiLine", True).schema("images array<struct<url:string,title:string>>").json(path)
    rows = raw.select(F.posexplode("images").alias("i", "m")).where("coalesce(m.url, '') <> ''")
    return rows.select(F.col("i").cast("long").alias("img_id"), "m.url", "m.title")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, data) with data as RGBA. Spark's image source gives BGR or BGRA."""
    raw = spark.read.format("image").load(path).select("image.*")

    def rgba(parts):
        import numpy as np
        import pandas as pd

        for frame in parts:
            out = []
            for data, n, w, h in zip(frame["data"], frame["nChannels"], frame["width"], frame["height"], strict=True):
                p = np.frombuffer(data, np.uint8).reshape(h, w, n)
                p = p.repeat(3, axis=2) if n == 1 else p[:, :, [2, 1, 0]] if n == 3 else p[:, :, [2, 1, 0, 3]]
                p = p if p.shape[2] == 4 else np.dstack([p, np.full((h, w, 1), 255, np.uint8)])
                out.append(p.tobytes())
            yield pd.DataFrame({"path": frame["origin"], "width": frame["width"], "height": frame["height"], "data": out})

    return raw.mapInPandas(rgba, "path string, width int, height int, data binary")


def results(hits: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits with what a result list shows: link and title with their fallbacks. """
    have = [c for c in ("path", "url", "title", "description") if c in rows.columns]
    shown = rows.select(F.col(id_col), *have)
    for c in ("path", "url", "title", "description"):
        if c not in have:
            shown = shown.withColumn(c, F.lit(None).cast("string"))
    joined = shown.join(hits, id_col)
    return joined.select(*hits.columns, or_else(F.col("path"), F.col("url"), "#").alias("link"), or_else(F.col("title"), F.col("path"), "(untitled)").alias("title"), F.coalesce("description", F.lit("")).alias("description"))


def write_binary(df: DataFrame, path: str, data_col: str = "png") -> None:
    """Encoded images as a table with their keys; files of their own are left to the store that serves them."""
    df.write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(path)


def write_pings(df: DataFrame, path: str, columns: list[str]) -> None:
    """One JSON line per event."""
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


__all__ = ["INDEX_FIELDS", "fit_length", "read_document_list", "read_embeddings", "read_image_list", "read_images", "read_site_index", "results", "write_binary", "write_pings"]
