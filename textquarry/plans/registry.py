"""Registered queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import images as I
from textquarry.functions import pages as P
from textquarry.functions import text as T
from textquarry.operators import compare as M
from textquarry.operators import search as S
from textquarry.operators import simhash as H
from textquarry.operators import vectors as V
from textquarry.operators.components import connected_components
from textquarry.plans import oracles
from textquarry.sources import datagen, files
from textquarry.sources.shared import read_table, written
from textquarry.streaming import chunks as C

#: The phrases of the search queries.
EXACT = {0: "the of and", 1: "ering thion on the", 2: "de la ou"}
FUZZY = {0: "thble ering"}
BATCH = {0: "thble ering", 1: "thbel ertoin", 2: "onnig", 3: "the the onnig", 4: "zzzzqqqq"}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def tokens_per_doc(spark, d):
    return S.token_counts(_docs(spark, d)).select("doc_id", F.col("dl").alias("n_tokens"))


def term_frequency(spark, d):
    return S.term_frequency(_docs(spark, d)).select("doc_id", "term", "tf")


def corpus_stats(spark, d):
    return S.corpus_stats(_docs(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


def vocab_df_idf(spark, d):
    return S.build_index(_docs(spark, d)).vocabulary.select("term", "df", F.round(F.col("idf").cast("double"), 4).alias("idf"))


def postings_offsets(spark, d):
    return S.postings_offsets(S.build_index(_docs(spark, d)))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round(F.col("score").cast("double"), 4))


def fuzzy_expand(spark, d):
    index = S.build_index(_docs(spark, d))
    return S.expand(index, S.query_terms(spark, BATCH)).select("query_id", "qi", "query_term", "term", "distance", "edits")


def fuzzy_expand_by_deletions(spark, d):
    index = S.build_index(_docs(spark, d))
    return S.expand(index, S.query_terms(spark, BATCH), broadcast_terms=False).select("query_id", "qi", "query_term", "term", "distance", "edits")


def bm25_exact_topk(spark, d):
    return _rounded(S.search(S.build_index(_docs(spark, d)), EXACT, k=10, fuzziness=0))


def bm25_fuzzy_topk(spark, d):
    return _rounded(S.search(S.build_index(_docs(spark, d)), FUZZY, k=10))


def bm25_batch_rank(spark, d):
    return _rounded(S.search(S.build_index(_docs(spark, d)), BATCH, k=5))


def subsequence_score_topk(spark, d):
    scored = _docs(spark, d).select("doc_id", S.subsequence_score("thering", F.col("text")).alias("score")).where("score > 0")
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(10)


def fnv1a64_terms(spark, d):
    terms = S.token_counts(_docs(spark, d)).select(F.explode("tokens").alias("term")).distinct()
    return terms.select("term", T.fingerprint_hex(T.fnv1a64(F.col("term"))).alias("hash"))


def simhash_fingerprint(spark, d):
    return H.fingerprint(_docs(spark, d)).select("doc_id", T.fingerprint_hex(F.col("fingerprint")).alias("fingerprint"))


def simhash_pairs(spark, d):
    return H.near_pairs(H.fingerprint(_docs(spark, d)), 3, blocks=5)


def simhash_first_pairs(spark, d):
    return H.first_pairs(H.fingerprint(_docs(spark, d)), 3, 12)


def simhash_groups(spark, d):
    return H.groups(H.fingerprint(_docs(spark, d)), 3, blocks=5)


def vector_normalize(spark, d):
    v = V.normalize(F.col("embedding"))
    return read_table(spark, d, "embeddings").select("vec_id", F.transform(v, lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


def cosine_scores(spark, d):
    corpus = read_table(spark, d, "embeddings")
    scored = V.cosine_scores(corpus, corpus.where("vec_id % 100 = 0"))
    return scored.select("query_id", "vec_id", (F.round("score", 5) + 0.0).alias("score"))


def knn_topk(spark, d):
    corpus = read_table(spark, d, "embeddings")
    return V.knn(corpus, corpus.where("vec_id % 100 = 0"), 8, digits=5)


def truncation_delta(spark, d):
    """Scores of every hundredth vector against all, by whole vectors and by their first 32 values."""
    rows = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = V.knn(rows, rows.where("vec_id % 100 = 0"), 8, digits=5).select("query_id", "vec_id")
    pairs = written(near.join(rows, "vec_id").join(asked, "query_id"), "pairs")
    unit = lambda c, n: V.normalize(V.fit_length(F.col(c), n) if n else F.col(c))
    score = lambda n: F.round(V.dot(unit("embedding", n), unit("q", n)), 5).alias("score")
    keys = ["query_id", "vec_id"]
    found = M.compare(pairs.select(*keys, score(None)), pairs.select(*keys, score(32)), keys, "score")
    return found.select("n", "n_unmatched", "n_different", F.round("max_delta", 4).alias("max_delta"))


def term_ids(spark, d):
    return S.term_ids(_docs(spark, d))


def longest_document(spark, d):
    return S.longest(_docs(spark, d))


def first_documents(spark, d):
    return S.first_rows(_docs(spark, d), 50).select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


def fuzziness_agreement(spark, d):
    """Whether a search finds the same documents in the same order with and without typos allowed."""
    index = S.build_index(_docs(spark, d))
    return M.same_order(S.search(index, EXACT, k=10, fuzziness=0), S.search(index, EXACT, k=10), "query_id", "rank", "doc_id")


def planted_bits(spark, d):
    """How far the perceptual hashes of planted near copies are from those of their sources."""
    prints = written(_grays(spark, d).select("img_id", "source", I.phash_udf("gray").alias("hash")), "prints")
    copies = prints.where("source is not null").select(F.col("source").alias("img_id"), "hash")
    found = M.compare_hashes(prints.join(copies.select("img_id"), "img_id", "left_semi").select("img_id", "hash"), copies, ["img_id"], "hash")
    return found.withColumn("mean_bits", F.round("mean_bits", 6))


def stream_usage(spark, d):
    rows = _chunks(spark, d).withColumn("usage", F.when(F.col("seq") % 2 == 1, F.length(F.coalesce("chunk", F.lit("")))))
    return C.last_usage(rows).select("stream_id", "usage", C.usage_status(F.col("usage")).alias("status"))


def page_text(spark, d):
    return read_table(spark, d, "pages").select("page_id", P.page_text_udf()("html").alias("text"))


def page_prompt(spark, d):
    text = P.page_text_udf()("html")
    asked = P.prompt(F.col("text"), "Summarise the page.")
    return read_table(spark, d, "pages").select("page_id", text.alias("text")).select("page_id", P.messages_json("Answer from the page.", asked).alias("messages"))


def page_links(spark, d):
    return P.page_links(read_table(spark, d, "pages"))


def page_metadata(spark, d):
    """The pages name nothing, so each gets its address and, twice, its number put before it."""
    number = F.concat(F.lit('<meta name="page" content="'), F.col("page_id").cast("string"), F.lit('">'))
    address = F.concat(F.lit('<meta property="og:url" content="'), F.regexp_replace("url", "&", "&amp;"), F.lit('">'))
    return P.page_metadata(read_table(spark, d, "pages").select("page_id", F.concat(number, address, number, F.col("html")).alias("html")))


def url_parts(spark, d):
    rows = read_table(spark, d, "pages").select("page_id", "url", T.widget_parts(F.col("url")).alias("p"))
    return rows.select("page_id", "p.path", "p.name", T.resolve_url(F.col("url"), "/base").alias("resolved"), T.strip_slashes(F.col("url")).alias("bare"))


def url_params(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.to_json(T.query_params(F.col("url"))).alias("params"))


def slugify(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.class_name(F.col("url")).alias("slug"), T.camel_case(F.col("url")).alias("camel"))


def image_variants(spark, d):
    rows = read_table(spark, d, "pages").select("page_id", F.explode(T.image_variants(F.concat(F.col("url"), F.lit("/pic.png")))).alias("v"))
    return rows.select("page_id", "v.*")


def block_config(spark, d):
    none = F.array().cast("array<string>")
    cells = read_table(spark, d, "nation").select(F.col("n_regionkey").alias("block_id"), F.col("n_name").alias("key"), none.alias("links"), none.alias("images"), F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("paragraphs"), F.col("n_name").alias("text"))
    return P.block_config(cells).select("block_id", F.to_json("config").alias("config"))


def chat_messages_json(spark, d):
    turns = read_table(spark, d, "conversations")
    return turns.select("conv_id", "turn", P.messages_json("Answer briefly.", F.coalesce("text", F.lit(""))).alias("messages"))


def _chunks(spark, d) -> DataFrame:
    return read_table(spark, d, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"))


def chunk_fold(spark, d):
    return C.fold_deltas(_chunks(spark, d))


def chunk_reconcile(spark, d):
    rows = _chunks(spark, d)
    whole = C.fold_deltas(rows).select("stream_id", F.lit(1000000).cast("long").alias("seq"), F.concat("text", F.lit("!")).alias("chunk"))
    return C.fold_chunks(rows.unionByName(whole))


def sse_fold(spark, d):
    return C.fold_events(datagen.event_streams(read_table(spark, d, "conversations")))


def rum_weighted_counts(spark, d):
    rows = C.sampled(read_table(spark, d, "events"), 10)
    return rows.groupBy("event_type").agg(F.count("*").alias("n_sampled"), F.sum("weight").alias("n_estimated"), F.round(F.sum(F.col("value") * F.col("weight")), 2).alias("value_estimated"))


def latest_value(spark, d):
    rows = read_table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return C.latest(rows, key_cols=["user_id", "event_type"], value_col="event_id", time_col="at")


def field_concat(spark, d):
    rows = read_table(spark, d, "customer")
    return rows.select("c_custkey", T.join_fields(["c_name", "c_mktsegment", "c_comment"], rows.columns).alias("line"))


def result_list(spark, d):
    docs = _docs(spark, d)
    hits = S.term_frequency(docs).where("term = 'the'").orderBy(F.col("tf").desc(), "doc_id").limit(20).select("doc_id", "tf")
    return files.results(hits, docs.select("doc_id", F.col("source").alias("path"), F.col("lang").alias("title"))).drop("description")


def _grays(spark, d) -> DataFrame:
    return datagen.page_grays(read_table(spark, d, "pages"))


def dct8x8(spark, d):
    rows = _grays(spark, d).select("img_id", F.posexplode(I.dct_udf("gray")).alias("i", "c"))
    return rows.select("img_id", "i", (F.round(F.col("c").cast("double"), 2) + 0.0).alias("coefficient"))


def phash(spark, d):
    return _grays(spark, d).select("img_id", T.fingerprint_hex(I.phash_udf("gray")).alias("hash"))


def phash_groups(spark, d):
    prints = _grays(spark, d).select(F.col("img_id").alias("doc_id"), I.phash_udf("gray").alias("fingerprint"))
    return H.groups(prints, 8)


def gaussian_blur(spark, d):
    rows = datagen.page_rgba(read_table(spark, d, "pages"))
    return rows.select("img_id", F.sha2(I.blur_udf("data", "width", "height", F.lit(16)), 256).alias("sha256"))


def png_encode(spark, d):
    rows = datagen.page_rgba(read_table(spark, d, "pages")).select("img_id", "width", "height", I.png_udf("data", "width", "height").alias("png"))
    return rows.select("img_id", F.length("png").alias("bytes"), F.round(F.col("width") * F.col("height") * 4 / F.length("png"), 4).alias("ratio"), F.sha2("png", 256).alias("sha256"))


def planted_recall(spark, d):
    """Planted near copies that the perceptual hash finds within 8 bits."""
    prints = written(_grays(spark, d).select("img_id", "source", I.phash_udf("gray").alias("h")), "prints")
    pairs = prints.where("source is not null").join(prints.select(F.col("img_id").alias("source"), F.col("h").alias("g")), "source")
    return pairs.agg(F.count("*").alias("n"), F.count_if(H.hamming(F.col("h"), F.col("g")) <= 8).alias("found"))


def component_labels(spark, d):
    """Documents that share a source and a length, as a graph of links to the next one."""
    rows = _docs(spark, d).groupBy("source", F.floor(F.col("n_chars") / 100).alias("c")).agg(F.min("doc_id").alias("a"), F.collect_set("doc_id").alias("bs"))
    edges = rows.select("a", F.explode("bs").alias("b"))
    return connected_components(edges)


_NAMES = (
    tokens_per_doc, term_frequency, corpus_stats, vocab_df_idf, postings_offsets, fuzzy_expand, fuzzy_expand_by_deletions, bm25_exact_topk, bm25_fuzzy_topk, bm25_batch_rank,
    subsequence_score_topk, fnv1a64_terms, simhash_fingerprint, simhash_pairs, simhash_first_pairs, simhash_groups, vector_normalize, cosine_scores, knn_topk, truncation_delta,
    term_ids, longest_document, first_documents, fuzziness_agreement, planted_bits, stream_usage,
    page_text, page_prompt, page_links, page_metadata, url_parts, url_params, slugify, image_variants, block_config, chat_messages_json, chunk_fold, chunk_reconcile, sse_fold,
    rum_weighted_counts, latest_value, field_concat, result_list, dct8x8, phash, phash_groups, gaussian_blur, png_encode, planted_recall, component_labels,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMES}


def _marshalled(phrases: dict[int, str]) -> dict[int, list[str]]:
    return {q: S.marshal(p) for q, p in phrases.items()}


ORACLES: dict[str, str] = {
    **oracles.STATIC,
    "fuzzy_expand": oracles.expand_sql(_marshalled(BATCH), 2),
    "fuzzy_expand_by_deletions": oracles.expand_sql(_marshalled(BATCH), 2),
    "bm25_exact_topk": oracles.search_sql(_marshalled(EXACT), 0, 10),
    "bm25_fuzzy_topk": oracles.search_sql(_marshalled(FUZZY), 2, 10),
    "bm25_batch_rank": oracles.search_sql(_marshalled(BATCH), 2, 5),
    "fuzziness_agreement": f"""WITH a AS ({oracles.search_sql(_marshalled(EXACT), 0, 10)}), b AS ({oracles.search_sql(_marshalled(EXACT), 2, 10)}),
l AS (SELECT query_id, list(doc_id ORDER BY rank) AS x FROM a GROUP BY query_id), r AS (SELECT query_id, list(doc_id ORDER BY rank) AS y FROM b GROUP BY query_id)
SELECT query_id, coalesce(len(x), 0)::INT AS n_left, coalesce(len(y), 0)::INT AS n_right, x IS NOT DISTINCT FROM y AS same FROM l FULL JOIN r USING (query_id)""",
    "component_labels": """WITH e AS (SELECT source, floor(n_chars / 100) AS c, min(doc_id) AS component FROM documents GROUP BY ALL)
SELECT doc_id AS node, component FROM documents d JOIN e ON d.source = e.source AND floor(d.n_chars / 100) = e.c""",
}
