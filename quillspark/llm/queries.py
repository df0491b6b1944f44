"""Queries of the training-data operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import broadcast_small, dedup, read
from . import encoding, markup, mixture, rankwalk, sentences, sketch, splitting, subjects, termfreq

SCORES = ["dense_score", "lexical_score", "fusion_score", "rerank_score"]
RUN = ["run_id", "category", "difficulty"]


def _group(c: str):
    """Category and difficulty as groups: trimmed, lower case, ``unknown`` for none."""
    c = F.lower(strip(F.col(c)))
    return F.coalesce(F.when(c != "", c), F.lit("unknown"))


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    """Measured latencies, each result once."""
    rows = read(spark, sf, "item_results").select(
        "result_id", "run_id", _group("category").alias("category"), _group("difficulty").alias("difficulty"),
        "latency_ms", F.to_date("finished_at").alias("day"),
    )
    rows = rows.where(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0))
    return rows.dropDuplicates(["result_id"])


def p1_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sketches: bucket counts that can be kept and added up later."""
    return sketch.bucket_counts(_measured(spark, sf), [*RUN, "day"], "latency_ms").withColumn(
        "day", F.col("day").cast("string")
    )


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median and higher percentiles of every group, from daily pieces added up."""
    merged = sketch.merge_counts(p1_sketch(spark, sf), RUN)
    return sketch.percentiles(merged, RUN, [50, 90, 95, 99])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    counts = sketch.bucket_counts(_measured(spark, sf), RUN, "latency_ms")
    found = sketch.percentiles(counts, RUN, [50, 95, 99]).where(F.col("n") >= 200)
    bounds = read(spark, sf, "latency_bounds").select(_group("difficulty").alias("difficulty"), "pct", "max_ms")
    bounds = broadcast_small(bounds.dropDuplicates(["difficulty", "pct"]))
    found = found.withColumn("pct", F.col("pct").cast("int")).join(bounds, ["difficulty", "pct"])
    return found.where(F.col("value") > F.col("max_ms")).select(*RUN, "pct")


def p2_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The whole combined order of every question."""
    return rankwalk.rank_walk(read(spark, sf, "retrieved_chunks"), "qid", "chunk_id", SCORES)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_ranking(spark, sf).where(F.col("place") <= 3).select("qid", "place", "chunk_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = dedup(read(spark, sf, "chunks"), ["chunk_id"], "text").select(F.col("chunk_id").alias("id"), "text")
    quotes = dedup(read(spark, sf, "citations"), ["citation_id"], "quote")
    both = chunks.unionByName(quotes.select(F.col("citation_id").alias("id"), F.col("quote").alias("text")))
    return sentences.sentence_units(both, "id", "text")


def _term_records(spark: SparkSession, sf: str) -> DataFrame:
    chunks = dedup(read(spark, sf, "chunks"), ["chunk_id"], "text")
    items = dedup(read(spark, sf, "golden_items"), ["id"], "question")
    return chunks.select(F.concat(F.lit("c:"), "chunk_id").alias("record"), "text").unionByName(
        items.select(F.concat(F.lit("g:"), "id").alias("record"), F.col("question").alias("text"))
    )


def p4_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """``term, occurrences, records`` of the whole vocabulary."""
    return termfreq.term_frequencies(_term_records(spark, sf), "record", "text")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    ids = read(spark, sf, "chunks").select(F.concat(F.lit("c:"), "chunk_id").alias("r")).unionByName(
        read(spark, sf, "golden_items").select(F.concat(F.lit("g:"), "id").alias("r"))
    )
    records = ids.where(F.col("r").isNotNull()).distinct().count()
    return termfreq.mark_terms(p4_frequencies(spark, sf), records)


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk in pieces of at most 800 tokens with up to 100 tokens of overlap."""
    chunks = dedup(read(spark, sf, "chunks"), ["chunk_id"], "section", "text", "start_char")
    return splitting.split_oversized(chunks).withColumnRenamed("item_id", "chunk_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cut kind of each oversized chunk, from the pieces the splitter makes of it."""
    chunks = dedup(read(spark, sf, "chunks").where(F.length("text") > splitting.MAX_TOKENS), ["chunk_id"], "text")
    found = splitting.oversized_kind(chunks, "chunk_id", "text")
    return found.select(F.col("item_id").alias("chunk_id"), "cut_kind")


def p6_text(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text of every document that still shows its structure."""
    docs = dedup(read(spark, sf, "library_docs"), ["doc_id"], "text", "source", "content_type")
    return markup.markup_to_text(docs)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = dedup(read(spark, sf, "library_docs"), ["doc_id"], "text", "source", "content_type")
    return markup.markup_elements(docs)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_corpus(read(spark, sf, "documents"))


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Texts from their ids: the way back, character for character."""
    return encoding.decode_corpus(p7_ids(spark, sf))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", mixture.normal_source(F.col("source")).alias("source"), "text")
    return encoding.token_counts(docs, "text").select("doc_id", "source", "tokens")


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sized = mixture.cut_lineage(_sized(spark, sf))  # texts are encoded once; three columns are kept
    plan = mixture.cut_lineage(mixture.mixture_plan(sized, read(spark, sf, "mix_targets")))
    return mixture.mixture(sized, plan), plan


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, source, tokens, copies`` of every document that takes part."""
    return _mixed(spark, sf)[0]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixture.mixture_report(*_mixed(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_report(spark, sf).where("limited").select("source")


def _model(spark: SparkSession, sf: str) -> subjects.Model:
    return subjects.fit_subjects(read(spark, sf, "documents"), read(spark, sf, "subject_examples"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each document's sentences per subject."""
    return subjects.subject_shares(read(spark, sf, "documents"), _model(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.document_subjects(read(spark, sf, "documents"), _model(spark, sf))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_sketch, p1_percentiles, p2_found, p2_ranking, p3_found, p4_found, p4_frequencies,
            p5_found, p5_pieces, p6_found, p6_text, p7_ids, p7_decoded, p8_found, p8_mixture, p8_report,
            p9_found, p9_shares,
        )
    }


_GROUPS = r"""
SELECT DISTINCT ON (result_id) result_id, run_id,
  coalesce(nullif(lower(regexp_replace(category, '^\s+|\s+$', '', 'g')), ''), 'unknown') AS category,
  coalesce(nullif(lower(regexp_replace(difficulty, '^\s+|\s+$', '', 'g')), ''), 'unknown') AS difficulty,
  latency_ms
FROM item_results WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        # The exact percentile of rank ceil(p n): a bounded error must change no case.
        "p1_found": f"""
WITH m AS ({_GROUPS}),
r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY run_id, category, difficulty) AS n
  FROM m WINDOW w AS (PARTITION BY run_id, category, difficulty ORDER BY latency_ms)),
b AS (SELECT DISTINCT lower(trim(difficulty)) AS difficulty, pct, max_ms FROM latency_bounds)
SELECT r.run_id, r.category, r.difficulty, b.pct FROM r JOIN b USING (difficulty)
WHERE n >= 200 AND k = greatest(1, ceil(b.pct * n / 100.0)) AND latency_ms > max_ms""",
    }
