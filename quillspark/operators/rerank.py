"""Lexical reranking with IDF weights, top-n, and pluggable rerankers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens, normalize
from .sparse import SparseIndex

TOP_N, PHRASE_BONUS, FLOOR = 5, 0.25, 0.01


def term_weights(questions: DataFrame, index: SparseIndex | None, terms: Column | None = None) -> DataFrame:
    """``qid, weights MAP<term, weight>`` of each question's distinct terms; 1.0 without an index."""
    terms = lexical_tokens(F.col("question")) if terms is None else terms
    exploded = questions.select("qid", F.explode(F.array_distinct(terms)).alias("term"))
    if index is None or not index.ndocs:
        weighted = exploded.withColumn("w", F.lit(1.0)).withColumn("known", F.lit(False))
    else:
        weighted = exploded.join(index.idf.select("term", "idf"), "term", "left").select(
            "qid", "term", F.greatest(F.coalesce("idf", F.lit(index.max_idf)), F.lit(FLOOR)).alias("w"), F.col("idf").isNotNull().alias("known")
        )
    return weighted.groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights"),
        F.sum("w").alias("total_weight"),
        F.sum(F.when(F.col("known"), F.col("w")).otherwise(0.0)).alias("known_weight"),
    )


def lexical_score(weights: Column, total: Column, query_norm: Column, body: Column, section: Column, text_norm: Column) -> Column:
    """Coverage, density and heading hits in [0, 1], with a bonus for the whole phrase. Query and text are normalized."""
    got = lambda tokens: F.aggregate(
        F.filter(F.map_keys(weights), lambda t: F.array_contains(tokens, t)), F.lit(0.0), lambda a, t: a + weights[t]
    )
    coverage = got(body) / total
    matches = F.aggregate(body, F.lit(0.0), lambda a, t: a + F.coalesce(weights[t], F.lit(0.0)))
    density = matches / (total * F.sqrt(F.size(body)))
    score = 0.60 * coverage + 0.25 * F.least(density, F.lit(1.0)) + 0.15 * got(section) / total
    phrase = query_norm.contains(" ") & text_norm.contains(query_norm)
    score = F.least(score + F.when(phrase, PHRASE_BONUS).otherwise(0.0), F.lit(1.0))
    return F.when((F.coalesce(total, F.lit(0.0)) <= 0) | (F.size(body) == 0), 0.0).otherwise(score)


def lexical_rerank(candidates: DataFrame, questions: DataFrame, index: SparseIndex | None) -> DataFrame:
    """``candidates`` (qid, chunk_id, section, text, ...) with ``rerank_score``. A chunk's tokens are taken, and its text normalized, once."""
    weights = term_weights(questions, index).join(questions.select("qid", normalize(F.col("question")).alias("_norm")), "qid")
    tokens = candidates.select("chunk_id", "text", "section").dropDuplicates(["chunk_id"]).select(
        "chunk_id",
        lexical_tokens(F.coalesce("text", F.lit(""))).alias("_body"),
        lexical_tokens(F.coalesce("section", F.lit(""))).alias("_section"),
        normalize(F.coalesce(F.col("text"), F.lit(""))).alias("_text"),
    )
    joined = candidates.join(tokens, "chunk_id").join(weights, "qid", "left")
    score = lexical_score(F.col("weights"), F.col("total_weight"), F.col("_norm"), F.col("_body"), F.col("_section"), F.col("_text"))
    return joined.withColumn("rerank_score", score).drop("_body", "_section", "_text", "_norm", "weights", "total_weight", "known_weight")


def take_top(scored: DataFrame, n: int = TOP_N, score: str = "rerank_score") -> DataFrame:
    """Best ``n`` per question, ties in fused order; ``score`` becomes the row's score."""
    order = Window.partitionBy("qid").orderBy(F.round(score, 6).desc(), F.col("fused_rank"))
    return scored.withColumn("score", F.col(score)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def no_rerank(candidates: DataFrame, n: int = TOP_N) -> DataFrame:
    """Reranking off: the first ``n`` of the fused order keep their fusion score."""
    return candidates.where(F.col("fused_rank") <= n).withColumn("score", F.col("fusion_score")).withColumn("rank", F.col("fused_rank"))


def model_rerank(candidates: DataFrame, questions: DataFrame, reranker) -> DataFrame:
    """Scores of a pluggable reranker: any object with ``score(queries, passages) -> list``."""
    pairs = candidates.join(questions.select("qid", "question"), "qid").select(
        "qid", "chunk_id", "question", F.concat_ws("\n", F.when(F.col("section") != "", F.col("section")), F.col("text")).alias("passage")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = reranker.score(pdf["question"].tolist(), pdf["passage"].tolist())
            yield pdf[["qid", "chunk_id"]].assign(rerank_score=[float(x) for x in got])

    return candidates.join(pairs.mapInPandas(run, "qid string, chunk_id string, rerank_score double"), ["qid", "chunk_id"])
