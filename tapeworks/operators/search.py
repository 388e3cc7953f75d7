"""Keyword search over documents by an inverted index, many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import safe_truncate
from ..sources.io import staged


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of the given terms: lower-case runs of letters and digits, over whole texts.

    All other words leave right after they are cut, before anything is shuffled or counted.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    said = docs.select("doc_id", F.explode(words).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    return said.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, snippet: int = 60) -> DataFrame:
    """queries (query_id, query) to the k documents of largest tf-idf sum: query_id, rank, doc_id, score, snippet.

    Texts are cut once; document frequencies come from the written postings.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("query"), r"[^\p{L}\p{N}]+"))).alias("term")).filter("term <> ''")
    found = staged(postings(docs, wanted), "postings")
    weights = found.groupBy("term").agg(F.count("*").alias("df")).crossJoin(docs.agg(F.count("*").alias("n")))
    weights = weights.join(wanted, "term").select("term", "query_id", F.ln(F.col("n") / F.col("df")).alias("idf"))
    scores = found.join(weights, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 4).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    return ranked.join(docs.select("doc_id", safe_truncate(F.col("text"), snippet).alias("snippet")), "doc_id").select("query_id", "rank", "doc_id", "score", "snippet")
