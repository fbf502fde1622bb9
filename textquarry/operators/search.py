"""Typo-tolerant BM25 search over an inverted index held in DataFrames.

build_index() makes postings (term, doc_id, tf, dl), the vocabulary (term, df, idf) and one row of corpus
statistics. search() expands the query terms over the vocabulary, joins the matches to the postings and
ranks. Of a (query term, document) the best match counts; over query terms scores are added up in
the order of the query. Weights are rounded to 32 bits where the index stores them, arithmetic is 64 bit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import text as T
from textquarry.sources.shared import written

#: Up to so many query terms are broadcast against the vocabulary; more are matched by deletions.
BROADCAST_TERMS = 4096
#: Up to so many forms that deletions leave of the query terms are broadcast; beyond that both sides are shuffled.
BROADCAST_FORMS = 1 << 17


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    max_edits: int = 2
    max_k: int = 256


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Write for reuse: postings by term, so that a read of some terms skips most row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "vocabulary", "stats")))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl, tokens) of every document."""
    tokens = T.tokenize(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens")).withColumn("dl", F.size("tokens"))


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, dl, counts): counts are the row's distinct terms with their tf, found in the row itself by sorting."""

    def runs_of(sorted_terms: Column) -> Column:
        n = F.size(sorted_terms)
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | (F.get(sorted_terms, i) != F.get(sorted_terms, i - 1))))
        return T.bind(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(sorted_terms, i).alias("term"), (F.coalesce(F.get(at, k + 1), n) - i).cast("long").alias("tf"))))

    rows = token_counts(docs, id_col, text_col)
    return rows.select("doc_id", "dl", T.bind(F.sort_array("tokens"), runs_of).alias("counts"))


def _postings(counted: DataFrame) -> DataFrame:
    return counted.select("doc_id", "dl", F.explode("counts").alias("c")).select("doc_id", "c.term", "c.tf", "dl")


def term_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): each row is a document, whose terms are counted without a shuffle."""
    return _postings(_counted(docs, id_col, text_col))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents (with or without tokens), tokens and mean length, 0 for no documents."""
    return _stats(token_counts(docs, id_col, text_col))


def _stats(lengths: DataFrame) -> DataFrame:
    rows = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))
    return rows.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.col("n_docs")).otherwise(0.0))


def vocabulary(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf), idf as a 32-bit number."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + ((F.col("n_docs") - F.col("df")) + 0.5) / (F.col("df") + 0.5)).cast("float")
    return df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", idf.alias("idf"))


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> Index:
    """keep: write the documents' term counts and the vocabulary to the shared folder; texts are then tokenised once."""
    counted = _counted(docs, id_col, text_col)
    if keep:
        counted = written(counted, "counts")
    stats, postings = _stats(counted), _postings(counted)
    words = vocabulary(postings, stats)
    return Index(postings, written(words, "vocabulary") if keep else words, stats)


def postings_offsets(index: Index) -> DataFrame:
    """(term, df, first, end): where a term's postings lie if all are laid out by term.

    The running sum is taken within ranges of terms and then over ranges, never in one task.
    """
    ranged = index.vocabulary.select("term", "df").repartitionByRange("term").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    inside = Window.partitionBy("part").orderBy("term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = ranged.groupBy("part").agg(F.sum("df").alias("size"))
    # one row for each range, so this sum is over as many rows as there are tasks
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("base"))
    rows = ranged.withColumn("upto", F.sum("df").over(inside)).join(before, "part")
    return rows.select("term", "df", (F.col("base") + F.col("upto") - F.col("df")).alias("first"), (F.col("base") + F.col("upto")).alias("end"))


def term_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, term_id): terms numbered from 0 by their first occurrence, documents in the order of their ids.

    Of each document only the first place of a term is shuffled. Numbers are given within ranges of first
    occurrences and carried over ranges, never in one task.
    """
    words = token_counts(docs, id_col, text_col).select("doc_id", F.posexplode("tokens").alias("at", "term"))
    first = words.groupBy("term").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    ranged = written(first.repartitionByRange("first").withColumn("part", F.spark_partition_id()), "first")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    # one row for each range
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("first")
    return ranged.withColumn("nth", F.row_number().over(inside)).join(before, "part").select("term", (F.col("base") + F.col("nth") - 1).alias("term_id"))


def longest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: the tokens of the longest document, 0 for no documents."""
    return token_counts(docs, id_col, text_col).agg(F.coalesce(F.max("dl"), F.lit(0)).alias("max_tokens"))


def first_rows(docs: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The n documents of the smallest ids; null ids come first. Each task sends n at most."""
    return docs.orderBy(id_col).limit(n)


# ---- queries ----------------------------------------------------------------------------------------


def marshal(phrase: str) -> list[str]:
    """The terms of a phrase that fit a query: a term over the limit of characters is skipped, not the rest."""
    import re

    terms, used = [], 0
    for run in re.findall("[a-z0-9]+", (phrase or "").lower()):
        term = run[: T.TOKEN_CHARS]
        if len(terms) >= T.QUERY_TERMS:
            break
        if used + len(term) <= T.QUERY_CHARS:
            terms.append(term)
            used += len(term)
    return terms


def query_terms(spark: SparkSession, phrases: dict[int, str]) -> DataFrame:
    rows = [(q, i, t) for q, phrase in phrases.items() for i, t in enumerate(marshal(phrase))]
    return spark.createDataFrame(rows, "query_id int, qi int, query_term string")


def expand(index: Index, terms: DataFrame, *, cap: int = 2, broadcast_terms: bool = True) -> DataFrame:
    """(query_id, qi, query_term, term, distance, edits, idf): vocabulary terms within the allowed edits.

    Query terms are few, so they are broadcast and lengths and Levenshtein rule out nearly every pair before
    the exact distance. For many query terms both sides are joined on what deletions leave of them: two
    terms within d edits share a form with at most d deletions on either side. The vocabulary's forms are many
    times as large as its file, by which Spark sizes them, so they are never left to be broadcast.
    """
    asked = terms.withColumn("edits", T.allowed_edits(F.col("query_term"), cap))
    words = index.vocabulary
    if broadcast_terms:
        near = words.join(F.broadcast(asked), T.may_match(F.col("query_term"), F.col("term"), F.col("edits")))
    else:
        left = asked.select("query_id", "qi", "query_term", "edits", F.explode(T.deletions(F.col("query_term"), cap)).alias("form"))
        right = words.select("term", "idf", F.explode(T.deletions(F.col("term"), cap)).alias("form"))
        few = left.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS
        near = right.join(F.broadcast(left) if few else left.hint("merge"), "form").where(T.may_match(F.col("query_term"), F.col("term"), F.col("edits"))).drop("form").distinct()
    # up to 1 Levenshtein's distance is the same; above it a swap of neighbours may make the exact one smaller
    plain, possible = F.levenshtein("query_term", "term"), T.may_match(F.col("query_term"), F.col("term"), F.col("edits"))
    # the optimizer moves the filter below into the join's condition, in front of the others: so the cheap test comes first in here as well
    distance = F.when(~possible, 1 << 20).when(plain <= 1, plain).otherwise(T.osa(F.col("query_term"), F.col("term")))
    near = near.select("query_id", "qi", "query_term", "term", "edits", "idf", distance.alias("distance"))
    return near.where("distance <= edits")


def term_score(weight: Column, tf: Column, dl: Column, avgdl: Column, p: Bm25) -> Column:
    k1, b = (F.lit(x).cast("float").cast("double") for x in (p.k1, p.b))
    tf = tf.cast("float").cast("double")
    return weight * (tf * (k1 + 1)) / (tf + k1 * (F.lit(1.0) - b + b * dl.cast("double") / avgdl.cast("float").cast("double")))


def scores(index: Index, matches: DataFrame, p: Bm25 = Bm25()) -> DataFrame:
    """(query_id, doc_id, score) of all documents with a match; scores are 32-bit numbers."""
    weighted = matches.select("query_id", "qi", "term", (F.col("idf").cast("double") * T.boost(F.col("distance"), F.col("edits"))).alias("weight"))
    hits = index.postings.join(weighted, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    one = term_score(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl"), p).cast("float")
    # one exchange: a list holds at most a document's distinct terms for each term of the query
    met = hits.select("query_id", "doc_id", F.struct("qi", one.alias("s")).alias("x")).groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    last = F.filter("xs", lambda x, i: F.coalesce(F.get(F.col("xs"), i + 1)["qi"] != x["qi"], F.lit(True)))
    total = F.aggregate(last, F.lit(0).cast("float"), lambda a, x: (a + x["s"]).cast("float"))
    return met.select("query_id", "doc_id", total.alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, limit: int = 256, id_col: str = "doc_id") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller id. k of 0 or less gives none."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(0, min(k, limit)))


def search(index: Index, phrases: dict[int, str], *, k: int = 10, fuzziness: int = 2, p: Bm25 = Bm25()) -> DataFrame:
    """(query_id, rank, doc_id, score) for a batch of phrases."""
    terms = query_terms(index.postings.sparkSession, phrases)
    few = sum(len(marshal(x)) for x in phrases.values()) <= BROADCAST_TERMS
    matches = expand(index, terms, cap=min(fuzziness, p.max_edits), broadcast_terms=few)
    return top_k(scores(index, matches, p), k, p.max_k).select("query_id", "rank", "doc_id", "score")


# ---- subsequence scorer -----------------------------------------------------------------------------


def subsequence_score(needle: str, text: Column) -> Column:
    """In-order character match: 1 a hit, twice the run before it, 3 at the start, 2 behind a separator, and
    its earliness (n - i) / n; 0 unless all characters match, 1 for an empty needle.

    Matching is greedy, so each character of the needle is looked for natively behind the hit before it: as many
    steps as the needle is long, whatever the text's length.
    """
    if not needle:
        return F.lit(1.0)
    lower = F.lower(F.coalesce(text, F.lit("")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0.0).cast("double").alias("score"))

    def walk(t: Column) -> Column:
        n = F.length(t).cast("double")

        def hit(s: Column, p: Column) -> Column:
            """p: the character's first place behind the last hit, from 1; 0 for none."""
            run = F.when((s["at"] > 0) & (p == s["at"] + 1), s["run"]).otherwise(0)
            gain = F.lit(1.0) + run * 2 + F.when(p == 1, 3).when(F.substr(t, p - 1, F.lit(1)).rlike(r"[ \-/_.,:(]"), 2).otherwise(0) + (n - (p - 1)) / n
            found = F.struct(p.alias("at"), (run + 1).alias("run"), (s["score"] + gain).alias("score"))
            return F.when(p > 0, found).otherwise(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("run"), s["score"].alias("score")))

        # once a character is missing, at stays -1
        step = lambda s, c: T.bind(F.when(s["at"] >= 0, F.position(c, t, s["at"] + 1)).otherwise(0), lambda p: hit(s, p))
        return F.aggregate(F.array(*map(F.lit, needle.lower())), start, step, lambda s: F.when(s["at"] > 0, s["score"]).otherwise(0.0))

    return T.bind(lower, walk)
