"""Incremental upkeep of documents, chunks and vectors by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, safe_filename

SUFFIXES = (".md", ".markdown", ".mdown", ".txt", ".text", ".rst", ".pdf", ".html", ".htm")
MAX_BYTES = 20 * 1024 * 1024


class IndexMismatch(ValueError):
    """The stored vectors come from another embedder."""


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def diff(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """``doc_id, content_hash, change``: ``new``, ``changed`` or ``unchanged`` by text only."""
    now = documents.select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    old = manifest.select("doc_id", F.col("content_hash").alias("old_hash"))
    change = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("content_hash"), "changed").otherwise("unchanged")
    return now.join(old, "doc_id", "left").select("doc_id", "content_hash", change.alias("change"))


def sync_plan(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``doc_id, action``: insert, update, delete or keep, from files present and documents known."""
    now = files.select("doc_id", content_hash(F.col("text")).alias("h"))
    old = manifest.select("doc_id", F.col("content_hash").alias("o"))
    action = (
        F.when(F.col("h").isNull(), "delete").when(F.col("o").isNull(), "insert").when(F.col("h") != F.col("o"), "update").otherwise("keep")
    )
    return now.join(old, "doc_id", "full_outer").select("doc_id", action.alias("action"))


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key, others are kept."""
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*store.columns))


def delete(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``store`` without the given keys; unknown keys are ignored."""
    return store.join(ids.select(key).distinct(), key, "left_anti")


def replace_documents(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of the documents in ``chunks`` are replaced."""
    return upsert(store, chunks, "doc_id")


def get_many(store: DataFrame, wanted: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows in request order (``position``); missing keys are skipped."""
    return wanted.select(key, "position").join(store, key).orderBy("position")


def manifest_of(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, source, title, content_type, content_hash, chunks``."""
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    rows = documents.select("doc_id", "source", "title", "content_type", content_hash(F.col("text")).alias("content_hash"))
    return rows.join(counts, "doc_id", "left").fillna(0, ["chunks"])


def stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def ingest_report(changes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: changed documents, their chunks, skipped documents."""
    got = changes.agg(
        F.count_if(F.col("change") != "unchanged").alias("documents"), F.count_if(F.col("change") == "unchanged").alias("skipped")
    )
    touched = changes.where(F.col("change") != "unchanged").select("doc_id")
    made = chunks.join(touched, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("chunks"))
    return got.join(F.broadcast(made))  # one row each


def check_fingerprint(recorded: str | None, current: str, rows: int) -> None:
    if recorded and recorded != current and rows:
        raise IndexMismatch(f"the store holds vectors of {recorded}, not {current}; reset or rebuild it")


def validate_uploads(files: DataFrame, known: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``name, safe_name, reason``; ``reason`` is NULL for accepted uploads.

    ``files`` has ``name, text, n_bytes, doc_id``; ``known`` has ``doc_id, name``. A document id
    that another file name already has is a duplicate; the same name replaces.
    """
    named = files.withColumn("safe_name", safe_filename(F.col("name"), SUFFIXES))
    owner = known.select("doc_id", F.col("name").alias("owner"))
    joined = named.join(owner, "doc_id", "left")
    reason = (
        F.when(F.col("safe_name").isNull(), "unsupported_type")
        .when(F.coalesce("n_bytes", F.lit(0)) == 0, "empty")
        .when(F.col("n_bytes") > max_bytes, "too_large")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty")
        .when(F.col("owner").isNotNull() & (F.col("owner") != F.col("safe_name")), "duplicate_document")
    )
    return joined.select("doc_id", "name", "safe_name", reason.alias("reason"))


def unknown_ids(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Asked-for documents that are not in the library."""
    return wanted.select("doc_id").distinct().join(manifest, "doc_id", "left_anti")


def listing(manifest: DataFrame) -> DataFrame:
    """Documents with their file name, in case-insensitive order of it."""
    name = F.element_at(F.split("source", r"[\\/]"), -1)
    return manifest.withColumn("filename", name).orderBy(F.lower("filename"), "doc_id")
