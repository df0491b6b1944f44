"""The chains: ingest documents, retrieve for a table of questions, answer, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import load_config, missing_requirements
from ..operators import answering, dense, fusion, rerank, sparse
from ..functions.text import strip
from ..operators.chunking import ChunkRules, chunk_documents, embedding_text
from ..operators.maintenance import check_fingerprint, diff, ingest_report, manifest_of
from ..providers import EMBEDDERS, GENERATORS, RERANKERS, create
from ..session import cut_lineage
from ..sources.sinks import LibraryStore


@dataclass
class Corpus:
    """Chunks with both indexes; built once and used for any number of question tables."""

    chunks: DataFrame
    index: sparse.SparseIndex
    vectors: DataFrame
    embedder: object


def provided(config: dict, section: str, registry: dict, given=None, **options):
    """The stage's object: the one given, or the configured provider's. A provider nobody registered raises."""
    if given is not None:
        return given
    name = config[section]["provider"]
    if name not in registry:
        missing = missing_requirements({section: config[section]}, set()) or [name]
        raise ValueError(f"the {section} provider {name!r} is not registered; it needs {', '.join(missing)}")
    return create(registry, name, **options)


def embedder_of(config: dict, given=None):
    e = config["embedding"]
    options = {"dimension": e["dimension"], "normalise": e["normalize"]} if e["provider"] == "hashing" else {}
    return provided(config, "embedding", EMBEDDERS, given, **options)


def vectors_of(chunks: DataFrame, embedder) -> DataFrame:
    body = embedding_text(*[F.coalesce(F.col(c), F.lit("")) for c in ("title", "section", "text")])
    return dense.embed_texts(chunks, "chunk_id", body, embedder)


def index_chunks(chunks: DataFrame, embedder=None, config: dict | None = None) -> Corpus:
    """Sparse and dense index of distinct chunks."""
    embedder = embedder_of(config or load_config(env={}), embedder)
    return Corpus(chunks, sparse.build_index(chunks), vectors_of(chunks, embedder).persist(), embedder)


def checked_questions(questions: DataFrame) -> DataFrame:
    """Questions without surrounding white space; an error if one is blank. For calls that may not skip any."""
    asked = questions.withColumn("question", strip(F.col("question")))
    blank = asked.where(F.coalesce(F.col("question"), F.lit("")) == "").select("qid").take(1)
    if blank:
        raise ValueError(f"question {blank[0][0]!r} is empty")
    return asked


def retrieve(corpus: Corpus, questions: DataFrame, config: dict | None = None, doc_ids: DataFrame | None = None) -> DataFrame:
    """Fused candidates of each question (``qid, question``), with their chunks. Blank questions find nothing."""
    r = (config or load_config(env={}))["retrieval"]
    asked = questions.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    allowed = fusion.scope(corpus.chunks, doc_ids) if doc_ids is not None else None
    lexical = sparse.search(corpus.index, asked, r["lexical_k"], allowed)
    qvecs = dense.embed_texts(asked.select("question").distinct(), "question", F.col("question"), corpus.embedder)  # equal questions once
    near = dense.cosine_top_k(corpus.vectors, qvecs, r["dense_k"], qid="question", allowed=allowed)
    near = asked.select("qid", "question").join(near, "question").drop("question")
    return fusion.hydrate(fusion.fuse(near, lexical, r["fusion"], r["candidates"], r["rrf_k"]), corpus.chunks)


def rank(
    corpus: Corpus, questions: DataFrame, candidates: DataFrame, config: dict | None = None, top_n: int | None = None, reranker=None
) -> DataFrame:
    """Passages reranked by the configured provider; ``top_n`` 0 or None means the configured number."""
    config = config or load_config(env={})
    r = config["rerank"]
    n = top_n or r["top_n"]
    if not r["enabled"]:
        return rerank.no_rerank(candidates, n)
    if reranker is None and r["provider"] == "lexical":
        return rerank.take_top(rerank.lexical_rerank(candidates, questions, corpus.index), n)
    return rerank.take_top(rerank.model_rerank(candidates, questions, provided(config, "rerank", RERANKERS, reranker)), n)


def answer(
    corpus: Corpus, questions: DataFrame, config: dict | None = None, doc_ids: DataFrame | None = None, top_n: int | None = None,
    generator=None, reranker=None,
) -> DataFrame:
    """A cited answer or an abstention with its reason, one row per question; blank questions find nothing."""
    config = config or load_config(env={})
    generator = provided(config, "generation", GENERATORS, generator)
    c, g = config["citations"], config["generation"]
    gates = answering.Gates(
        min_top_score=c["min_top_score"], min_question_coverage=c["min_question_coverage"], min_grounding=c["min_grounding"],
        min_sources=c["min_sources"], require_citations=c["require_citations"],
        max_chars_per_source=g["max_chars_per_source"], max_context_chars=g["max_context_chars"],
    )
    questions = questions.persist()
    candidates = cut_lineage(retrieve(corpus, questions, config, doc_ids))  # a few rows per question, read by several stages
    ranked = cut_lineage(rank(corpus, questions, candidates, config, top_n, reranker))
    return answering.answer_questions(questions, ranked, corpus.index, gates, generator)


def corpus_of(store: LibraryStore, config: dict | None = None, embedder=None) -> Corpus:
    """Both indexes over a stored library; an error if it is empty or its vectors come from another embedder."""
    embedder = embedder_of(config or load_config(env={}), embedder)
    chunks, vectors = store.read("chunks"), store.read("vectors")
    if chunks is None or vectors is None:
        raise ValueError("the store is empty; ingest documents first")
    check_fingerprint(store.fingerprint, embedder.fingerprint, 1)
    return Corpus(chunks, sparse.build_index(chunks), vectors, embedder)


def ingest(docs: DataFrame, folder: str, config: dict | None = None, embedder=None, remove: DataFrame | None = None) -> dict:
    """Bring the stored chunks, vectors and manifest up to date with ``docs``; documents in ``remove`` (doc_id) go.

    Documents whose text is unchanged are skipped; a changed document's chunks are
    replaced. Only the buckets of changed and removed documents are read and rewritten, and all tables
    change at once.
    """
    config = config or load_config(env={})
    embedder = embedder_of(config, embedder)
    spark = docs.sparkSession
    store = LibraryStore(spark, folder)
    known = store.read("manifest")
    if known is not None:
        check_fingerprint(store.fingerprint, embedder.fingerprint, 1)
    empty = spark.createDataFrame([], "doc_id string, content_hash string")
    changes = diff(docs, known if known is not None else empty).persist()
    ids = changes.where("change <> 'unchanged'").select("doc_id")
    touched_docs = docs.join(ids, "doc_id", "left_semi")
    fresh = chunk_documents(touched_docs, ChunkRules(**config["chunking"])).persist()
    report = ingest_report(changes, fresh).first().asDict()
    gone = remove.select("doc_id").distinct() if remove is not None else ids.limit(0)
    if known is not None and remove is not None:
        gone = gone.join(known.select("doc_id"), "doc_id", "left_semi")
        report["removed"] = gone.count()
    replaced = ids.unionByName(gone)
    if report["documents"] or report.get("removed"):
        touched = store.touched(replaced)
        rows = manifest_of(touched_docs, fresh).withColumn("fingerprint", F.lit(embedder.fingerprint))
        made = vectors_of(fresh, embedder).join(fresh.select("chunk_id", "doc_id"), "chunk_id")
        new = {"chunks": fresh, "vectors": made, "manifest": rows}
        for table, df in new.items():
            old = store.read(table, touched)
            if old is not None:
                new[table] = old.join(replaced, "doc_id", "left_anti").unionByName(df, allowMissingColumns=True)
        store.commit(new, touched, embedder.fingerprint)
    for df in (changes, fresh):
        df.unpersist()
    return report
