"""From questions to packed contexts: the ranking all configurations share, as one plan over many questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.functions.text import packing_tokens, tokens
from evidora.operators import ranking as rk


@dataclass(frozen=True)
class Profile:
    """Settings of a ranking: candidates of each list, fusion, places, rows of a table, and the budget in tokens."""

    candidates: int = 30
    rrf_k: int = 60
    top_k: int = 10
    per_table: int = 2
    context_tokens: int = 1500
    lexical: bool = True


def initial_ranking(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, profile: Profile) -> DataFrame:
    """(query_id, id, score, position): dense and lexical lists fused, tables diversified.

    questions (query_id, text, vector), chunks (id, text, table_key), vectors (id, vector).  A question does not find itself:
    rows whose id is the question's are left out.  Without the lexical list the dense order stays.
    """
    dense = rk.cosine_topk(questions.select(F.col("query_id").alias("id"), "vector"), vectors, profile.candidates, "id", "vector")
    lists = dense.select("query_id", F.lit("dense").alias("list"), "id", "position")
    if profile.lexical:
        asked = questions.select("query_id", tokens(F.col("text")).alias("tokens"))
        docs = chunks.select("id", tokens(F.col("text")).alias("tokens")).where("tokens is not null")
        words = rk.bm25(asked, docs, "tokens", profile.candidates)
        lists = lists.union(words.select("query_id", F.lit("lexical"), "id", "position"))
    fused = rk.rrf(lists.where("id <> query_id"), profile.rrf_k).select("query_id", "id", "score", F.col("fused").alias("position"))
    placed = rk.diversify(fused.join(chunks.select("id", "table_key"), "id"), profile.top_k, profile.per_table)
    return placed.select("query_id", "id", "score", F.col("place").alias("position"))


def packed_contexts(ranked: DataFrame, chunks: DataFrame, profile: Profile) -> DataFrame:
    """(query_id, contexts, tokens): the ranked texts that fit the budget, in rank order."""
    rows = ranked.join(chunks.select("id", "text"), "id").withColumn("size", packing_tokens(F.col("text")))
    units = rows.select("query_id", F.col("position").cast("long").alias("id"), "position", F.col("size").alias("tokens"))
    kept = rk.pack_first_fit(units, profile.context_tokens).select("query_id", "position", "size")
    texts = kept.join(rows.select("query_id", "position", "text"), ["query_id", "position"])
    return texts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("context"), F.count("*").alias("passages"), F.sum("size").alias("tokens"))
