"""A document library on a shared folder: add, sync, list, look up, delete, ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load_config
from ..operators import maintenance
from ..session import cut_lineage
from ..sources import loaders
from ..sources.sinks import LibraryStore
from . import pipeline


class DocumentNotFound(KeyError):
    """Asked for documents or passages that the library does not have."""


class Library:
    """All calls take and give tables; the state is the store's, so any number of sessions may read it."""

    def __init__(self, spark: SparkSession, folder: str, config: dict | None = None, embedder=None) -> None:
        self.spark, self.folder, self.config = spark, folder, config or load_config(env={})
        self.embedder = embedder

    @property
    def store(self) -> LibraryStore:
        return LibraryStore(self.spark, self.folder)

    def _manifest(self) -> DataFrame:
        found = self.store.read("manifest")
        if found is None:
            schema = "doc_id string, source string, title string, content_type string, content_hash string, chunks long, fingerprint string"
            found = self.spark.createDataFrame([], schema)
        return found

    def add(self, files: DataFrame, max_bytes: int = maintenance.MAX_BYTES) -> DataFrame:
        """Store uploads (``source, content``); gives ``doc_id, name, safe_name, reason``, the reason NULL where accepted.

        A file of the same name replaces; one whose document id belongs to another name is refused. Refused files change nothing.
        """
        files = files.persist()
        size = files.select("source", F.length("content").alias("n_bytes"))
        docs = loaders.load_documents(files.where(loaders.content_kind(F.col("source")).isNotNull())).persist()
        name = F.element_at(F.split("source", r"[\\/]"), -1)
        rows = size.join(docs.select("source", "text"), "source", "left")
        rows = rows.select(loaders.doc_id(F.col("source")).alias("doc_id"), name.alias("name"), "text", "n_bytes", "source")
        known = self._manifest().select("doc_id", name.alias("name"))
        checked = maintenance.validate_uploads(rows, known, max_bytes)
        verdict = cut_lineage(checked)  # the verdict is about the library as it was
        fine = docs.join(verdict.where(F.col("reason").isNull()).select("doc_id"), "doc_id", "left_semi")
        pipeline.ingest(fine, self.folder, self.config, self.embedder)
        return verdict

    def add_directory(self, path: str, include: list[str] | None = None) -> DataFrame:
        """``add`` for the files directly in a folder."""
        files = loaders.list_files(self.spark, path, include)
        root = path.rstrip("/")
        return self.add(files.where(~F.substring_index("source", root + "/", -1).contains("/")))

    def sync(self, docs: DataFrame) -> dict:
        """Make the library hold just ``docs``: new and changed ones are indexed, vanished ones dropped.

        Blank documents are skipped, not dropped from the count of what is there. Gives the number of each action.
        """
        present = docs.where(F.trim(F.coalesce("text", F.lit(""))) != "")
        plan = maintenance.sync_plan(present, self._manifest()).persist()
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        pipeline.ingest(present, self.folder, self.config, self.embedder, plan.where("action = 'delete'").select("doc_id"))
        plan.unpersist()
        return {a: counts.get(a, 0) for a in ("insert", "update", "delete", "keep")}

    def delete(self, doc_ids: list[str]) -> int:
        """Drop documents; unknown ones raise and nothing is dropped."""
        ids = self.known(doc_ids)
        empty = self.spark.createDataFrame([], "doc_id string, source string, title string, text string, content_type string, metadata map<string,string>")
        return pipeline.ingest(empty, self.folder, self.config, self.embedder, ids).get("removed", 0)

    def known(self, doc_ids: list[str]) -> DataFrame:
        ids = self.spark.createDataFrame([(d,) for d in dict.fromkeys(doc_ids)], "doc_id string")
        missing = sorted(r[0] for r in maintenance.unknown_ids(ids, self._manifest()).collect())
        if missing:
            raise DocumentNotFound(", ".join(missing))
        return ids

    def documents(self) -> DataFrame:
        return maintenance.listing(self._manifest())

    def get(self, doc_id: str) -> dict:
        self.known([doc_id])
        return self._manifest().where(F.col("doc_id") == doc_id).first().asDict()

    def passage(self, chunk_id: str) -> dict:
        """One chunk with all its columns."""
        chunks = self.store.read("chunks")
        row = chunks.where(F.col("chunk_id") == chunk_id).first() if chunks is not None else None
        if row is None:
            raise DocumentNotFound(chunk_id)
        return row.asDict()

    def ask(self, questions: DataFrame, doc_ids: list[str] | None = None, top_n: int | None = None, **providers) -> DataFrame:
        """Answers from the whole library or from some documents; blank questions and unknown documents raise."""
        asked = pipeline.checked_questions(questions)
        scope = self.known(doc_ids) if doc_ids else None
        corpus = pipeline.corpus_of(self.store, self.config, self.embedder)
        return pipeline.answer(corpus, asked, self.config, scope, top_n, **providers)


def projected(answers: DataFrame, trace: bool = False) -> DataFrame:
    """Answers as shown outside: scores rounded to 4 places, confidence and grounding to 2, ranks from 1; ``retrieved`` on demand."""
    cite = lambda c: c.withField("score", F.round(c["score"], 4))
    seen = lambda r, i: r.withField("score", F.round(r["score"], 4)).withField("rank", i + 1)
    out = answers.select(
        "qid", "text", F.col("reason").isNotNull().alias("abstained"), F.coalesce("reason", F.lit("")).alias("abstain_reason"),
        F.round("confidence", 2).alias("confidence"), F.round("grounding", 2).alias("grounding"), F.transform("citations", cite).alias("citations"),
        "input_tokens", "output_tokens", "model", "latency_ms", *(["retrieved"] if trace else []),
    )
    return out.withColumn("retrieved", F.transform("retrieved", seen)) if trace else out
