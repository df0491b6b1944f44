"""Fusion of the dense and the lexical leg, scoping, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, CANDIDATES = 60, 24


def scope(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``chunk_id`` of the chunks of the wanted documents, for both legs to filter by first."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id")


def fuse(dense: DataFrame, lexical: DataFrame, mode: str = "rrf", limit: int = CANDIDATES, rrf_k: int = RRF_K) -> DataFrame:
    """Fused candidates of each question.

    Both legs have ``qid, chunk_id, score, rank``. ``rrf`` adds ``1 / (rrf_k + rank)`` over the
    legs; ``dense_only`` and ``lexical_only`` keep that leg's score. Ties go to the
    better dense rank, then the better lexical rank.
    """
    if mode not in ("rrf", "dense_only", "lexical_only"):
        raise ValueError(f"unknown fusion {mode!r}")
    d = dense.select("qid", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    x = lexical.select("qid", "chunk_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    if mode == "dense_only":
        both = d.withColumns({"lexical_score": F.lit(None).cast("double"), "lexical_rank": F.lit(None).cast("int")})
        score = F.col("dense_score")
    elif mode == "lexical_only":
        both = x.withColumns({"dense_score": F.lit(None).cast("double"), "dense_rank": F.lit(None).cast("int")})
        score = F.col("lexical_score")
    else:
        both = d.join(x, ["qid", "chunk_id"], "full_outer")
        score = sum(F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "lexical_rank"))
    both = both.withColumn("fusion_score", score).withColumn("retriever", provenance())
    order = Window.partitionBy("qid").orderBy(
        F.round("fusion_score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last()
    )
    return both.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= limit)


def provenance():
    return (
        F.when(F.col("dense_rank").isNotNull() & F.col("lexical_rank").isNotNull(), "hybrid")
        .when(F.col("dense_rank").isNotNull(), "dense")
        .otherwise("lexical")
    )


def hydrate(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach chunk columns after the cut; candidates whose chunk is gone are skipped."""
    return fused.join(chunks.select("chunk_id", "doc_id", "source", "title", "section", "text"), "chunk_id")
