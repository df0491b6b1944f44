"""Queries of the engine's own operators over the test tables.

Every query runs over whole tables. Searches take their stated query sets: every golden
question against all chunks, and every vector whose id is divisible by 20 against all vectors.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sentences as S
from .functions import text as T
from .operators import answering, chunking, dense, evaluation, fusion, maintenance, rerank, sparse
from .plans import pipeline
from .session import dedup, read
from .sources import loaders

FLAGSHIP = "answer_questions"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracle_sql import ORACLES

    return {k: v for k, v in ORACLES.items() if k in QUERIES}


# --- inputs -----------------------------------------------------------------------


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(read(spark, sf, "chunks"), ["chunk_id"], "doc_id", "source", "title", "section", "text", "ordinal")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(
        read(spark, sf, "golden_items"), ["id"], "question", "reference_answer", "expected_sources", "answerable", "category", "difficulty"
    )


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select(F.col("id").alias("qid"), "question").where(F.col("question").isNotNull())


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "item_results").dropDuplicates(["result_id"])


def _library(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(read(spark, sf, "library_docs"), ["doc_id"], "source", "title", "text", "content_type", "metadata")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(
        read(spark, sf, "retrieved_chunks"), ["qid", "chunk_id"], "dense_score", "lexical_score", "dense_rank", "lexical_rank"
    )


@lru_cache(maxsize=4)
def _index(spark: SparkSession, sf: str) -> sparse.SparseIndex:
    return sparse.build_index(_chunks(spark, sf))


def _legs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both legs of the stored retrieval runs."""
    rows = _candidates(spark, sf)
    leg = lambda k: rows.where(F.col(f"{k}_rank").isNotNull()).select(
        "qid", "chunk_id", F.col(f"{k}_score").alias("score"), F.col(f"{k}_rank").alias("rank")
    )
    return leg("dense"), leg("lexical")


def _hydrated(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.hydrate(fusion.fuse(*_legs(spark, sf)), _chunks(spark, sf))


def _joined(c):
    return F.array_join(c, " ")


# --- text -------------------------------------------------------------------------


@query
def tokenize_docs(spark, sf):
    toks = T.tokenize(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(toks).alias("n"), _joined(toks).alias("tokens"))


@query
def content_tokens(spark, sf):
    toks = T.content_of(T.tokenize(F.col("text")))
    return _chunks(spark, sf).select("chunk_id", F.size(toks).alias("n"), _joined(toks).alias("tokens"))


@query
def stem_vocab(spark, sf):
    words = read(spark, sf, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("word")).distinct()
    return T.stem_column(words, "word", "stem")


@query
def lexical_term_freq(spark, sf):
    return sparse.postings_of(_chunks(spark, sf), "chunk_id", F.col("text")).groupBy("term").agg(
        F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")
    )


@query
def topical_terms(spark, sf):
    return _questions(spark, sf).select("qid", _joined(F.array_sort(F.array_distinct(T.topical_tokens(F.col("question"))))).alias("terms"))


@query
def token_count(spark, sf):
    return _chunks(spark, sf).select("chunk_id", T.count_tokens(F.col("text")).alias("tokens"))


@query
def logical_lines(spark, sf):
    rows = _chunks(spark, sf).where(F.col("text").isNotNull())
    return rows.select("chunk_id", F.array_join(S.logical_lines(F.col("text")), "\n").alias("lines"))


@query
def sentence_split(spark, sf):
    rows = _chunks(spark, sf).where(F.col("text").isNotNull())
    return rows.select("chunk_id", F.posexplode(S.split_sentences(F.col("text"))).alias("pos", "sentence"))


def _quotes(spark, sf):
    quotes = dedup(read(spark, sf, "citations"), ["citation_id"], "qid", "chunk_id", "quote", "source", "marker")
    return quotes.join(_chunks(spark, sf).select("chunk_id", "text"), "chunk_id")


@query
def overlap_ratio_quotes(spark, sf):
    rows = _quotes(spark, sf).select(
        "citation_id", T.lexical_tokens(F.col("quote")).alias("c"), T.lexical_tokens(F.col("text")).alias("r")
    )
    return rows.select("citation_id", F.round(evaluation.overlap_ratio(F.col("c"), F.col("r")), 6).alias("ratio"))


@query
def token_f1_answers(spark, sf):
    """Each distinct given answer against the reference of its golden item."""
    given = _results(spark, sf).where(F.col("answer").isNotNull() & ~F.col("abstained")).select("id", "answer").distinct()
    rows = given.join(_items(spark, sf), "id").select(
        "id", "answer", T.lexical_tokens(T.without_markers(F.col("answer"))).alias("p"), T.lexical_tokens(F.col("reference_answer")).alias("r")
    )
    return rows.select("id", "answer", F.round(evaluation.token_f1(F.col("p"), F.col("r")), 6).alias("f1"))


@query
def best_sentence(spark, sf):
    """The sentence of each cited chunk that covers its question best."""
    rows = _quotes(spark, sf).join(_questions(spark, sf), "qid").where(F.col("text").isNotNull())
    return S.best_sentences(rows, ["citation_id"], F.col("question"), F.col("text"))


@query
def truncate_text(spark, sf):
    return _chunks(spark, sf).where(F.col("text").isNotNull()).select("chunk_id", T.truncate(F.col("text"), 320).alias("short"))


@query
def content_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query
def numeric_questions(spark, sf):
    return _questions(spark, sf).select("qid", T.is_numeric_question(F.col("question")).alias("numeric"))


@query
def marker_extract(spark, sf):
    rows = _results(spark, sf).where(F.col("answer").isNotNull())
    return rows.select(
        "result_id", F.array_join(T.markers(F.col("answer")).cast("array<string>"), ",").alias("markers"),
        T.without_markers(F.col("answer")).alias("prose"),
    )


@query
def rich_text_tokens(spark, sf):
    rows = _results(spark, sf).where(F.col("answer").isNotNull())
    return rows.select("result_id", F.array_join(T.rich_text(F.col("answer")), "|").alias("spans"))


@query
def claims_by_marker(spark, sf):
    rows = _results(spark, sf).select("answer").where(F.col("answer").isNotNull()).distinct()
    return rows.select("answer", F.explode(S.claims(F.col("answer"))).alias("marker", "claim"))


@query
def display_formats(spark, sf):
    """Base name, byte and duration texts, and plural of the user interface."""
    rows = _library(spark, sf)
    size = F.length(F.coalesce("text", F.lit(""))).cast("bigint") * 977
    ms = size / F.lit(7)
    return rows.select(
        "doc_id", F.element_at(F.split("source", r"[\\/]"), -1).alias("basename"), size.alias("n_bytes"),
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1048576, F.concat(F.floor(size / 1024 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.regexp_replace(F.format_string("%.1f", F.floor(size / 104857.6 + 0.5) / 10), r"\.0$", ""), F.lit(" MB"))).alias("size"),
        F.when(ms >= 1000, F.concat(F.format_string("%.1f", F.floor(ms / 100 + 0.5) / 10), F.lit(" s")))
        .otherwise(F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).alias("duration"),
    )


#: What the user interface says for each reason.
EXPLANATIONS = {
    "no_results": "Nothing in the selected documents matched this question at all.",
    "low_relevance": "The closest passage wasn't relevant enough to answer from.",
    "question_not_covered": "A key term in your question doesn't appear anywhere in your documents.",
    "model_refusal": "The model judged the retrieved passages insufficient to answer.",
    "no_citations": "The generated answer couldn't be tied to a source, so it was withheld.",
    "low_grounding": "The answer wasn't supported closely enough by the passages it cited.",
    "empty_response": "The model returned nothing.",
}


@query
def abstain_explanations(spark, sf):
    words = F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])
    rows = evaluation.reason_histogram(_results(spark, sf))
    return rows.select("abstain_reason", words[F.col("abstain_reason")].alias("explanation"), "n")


@query
def quote_highlight(spark, sf):
    """Where a quote stands in its passage: text before and after it."""
    quote = F.regexp_replace(F.col("quote"), "…+$", "")
    at = F.instr("text", quote)
    rows = _quotes(spark, sf).where((F.coalesce("quote", F.lit("")) != "") & F.col("text").isNotNull() & (quote != ""))
    return rows.select(
        "citation_id", at.alias("place"),
        F.when(at > 0, at - 1).otherwise(-1).alias("n_before"),
        F.when(at > 0, F.length("text") - at - F.length(quote) + 1).otherwise(-1).alias("n_after"),
    )


# --- sources ------------------------------------------------------------------------


@query
def doc_id_slug(spark, sf):
    return _library(spark, sf).select("doc_id", loaders.doc_id(F.col("source")).alias("derived"))


@query
def safe_filename(spark, sf):
    names = _library(spark, sf).select("doc_id", F.concat("title", F.lit(" ?*"), F.regexp_extract("source", r"(\.[a-z]+)$", 1)).alias("name"))
    return names.select("doc_id", "name", T.safe_filename(F.col("name"), maintenance.SUFFIXES).alias("safe"))


@query
def frontmatter_parse(spark, sf):
    meta, body = loaders.front_matter(F.col("text"))
    rows = _library(spark, sf).where(F.col("text").isNotNull()).select("doc_id", meta.alias("m"), body.alias("b"))
    return rows.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["owner"].alias("owner"), F.length("b").alias("body_chars"))


@query
def markdown_title(spark, sf):
    rows = _library(spark, sf).where(F.col("text").isNotNull())
    return rows.select("doc_id", loaders.markdown_title(loaders.front_matter(F.col("text"))[1]).alias("title"))


def _kind_files(spark, sf, kind):
    return _library(spark, sf).where(loaders.content_kind(F.col("source")) == kind).select("source", "text").where(F.col("text").isNotNull())


@query
def markdown_load(spark, sf):
    return loaders.markdown_documents(_kind_files(spark, sf, "markdown")).drop("metadata")


@query
def text_load(spark, sf):
    return loaders.text_documents(_kind_files(spark, sf, "text")).drop("metadata")


@query
def html_load(spark, sf):
    return loaders.html_documents(_kind_files(spark, sf, "html")).drop("metadata")


@query
def loader_dispatch(spark, sf):
    rows = _library(spark, sf).withColumn("kind", loaders.content_kind(F.col("source")))
    return rows.groupBy(F.coalesce("kind", F.lit("unsupported")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def glob_match(spark, sf):
    rows = _library(spark, sf)
    return rows.where(loaders.glob_match(F.col("source"), ["**/*.md", "*.txt"]) & ~loaders.glob_match(F.col("source"), ["**/re*-*.md"])).select("doc_id", "source")


@query
def pdf_page_stitch(spark, sf):
    pages = _chunks(spark, sf).select(F.col("doc_id").alias("source"), (F.col("ordinal") + 1).alias("page"), F.col("text").alias("content"))
    return loaders.stitch_pages(pages)


@query
def dedup_documents(spark, sf):
    """First document of each distinct text."""
    docs = read(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return maintenance.first_wins(docs, "hash", "doc_id").select("doc_id", "hash")


# --- sparse -------------------------------------------------------------------------


@query
def bm25_idf(spark, sf):
    return _index(spark, sf).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def idf_max(spark, sf):
    i = _index(spark, sf)
    return i.lengths.agg(F.count(F.lit(1)).alias("ndocs"), F.round(F.avg("dl"), 6).alias("avgdl")).withColumn("max_idf", F.round(F.lit(i.max_idf), 6))


@query
def bm25_topk(spark, sf):
    found = sparse.search(_index(spark, sf), _questions(spark, sf), 20)
    return found.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _scope(spark, sf):
    """Documents that any golden item expects."""
    wanted = _items(spark, sf).select(F.explode("expected_sources").alias("source")).distinct()
    return _library(spark, sf).join(wanted, "source", "left_semi").select("doc_id")


@query
def bm25_scoped_topk(spark, sf):
    allowed = fusion.scope(_chunks(spark, sf), _scope(spark, sf))
    found = sparse.search(_index(spark, sf), _questions(spark, sf), 5, allowed)
    return found.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


# --- dense --------------------------------------------------------------------------


@query
def vector_l2_normalize(spark, sf):
    unit = dense.l2_normalize(F.col("embedding"))
    return read(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("pos", "x")).select("vec_id", "pos", F.round("x", 5).alias("x"))


def _near(spark, sf, k, allowed=None):
    vectors = read(spark, sf, "embeddings")
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    found = dense.cosine_top_k(vectors, asked, k, "vec_id", "embedding", "qid", "qv", allowed)
    return found.select("qid", "vec_id", F.round("score", 4).alias("score"), "rank")


@query
def cosine_topk(spark, sf):
    return _near(spark, sf, 10)


@query
def cosine_scoped_topk(spark, sf):
    return _near(spark, sf, 5, read(spark, sf, "embeddings").where(F.col("label") < 5).select("vec_id"))


@query
def ann_topk(spark, sf):
    """Approximate neighbours by cells; recall against ``cosine_topk`` is measured in the tests."""
    vectors = read(spark, sf, "embeddings")
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    cells = dense.fit_cells(vectors, "vec_id", "embedding")
    found = dense.approximate_top_k(dense.cell_index(vectors, cells, "vec_id", "embedding"), cells, asked, 10, "vec_id", "embedding", "qid", "qv")
    return found.select("qid", "vec_id", F.round("score", 4).alias("score"), "rank")


@query
def hashing_embed(spark, sf):
    return dense.embed_texts(_questions(spark, sf), "qid", F.col("question"))


@query
def dense_question_topk(spark, sf):
    c = _corpus(spark, sf)
    asked = dense.embed_texts(_questions(spark, sf), "qid", F.col("question"))
    return dense.cosine_top_k(c.vectors, asked, 20)


# --- fusion and rerank ----------------------------------------------------------------


def _fused(rows):
    return rows.select("qid", "chunk_id", F.round("fusion_score", 9).alias("fusion_score"), "retriever", "fused_rank")


@query
def rrf_fusion(spark, sf):
    return _fused(fusion.fuse(*_legs(spark, sf)))


@query
def fusion_dense_only(spark, sf):
    return _fused(fusion.fuse(*_legs(spark, sf), mode="dense_only"))


@query
def fusion_lexical_only(spark, sf):
    return _fused(fusion.fuse(*_legs(spark, sf), mode="lexical_only"))


@query
def fusion_provenance(spark, sf):
    return _candidates(spark, sf).groupBy(fusion.provenance().alias("retriever")).agg(F.count(F.lit(1)).alias("n"))


@query
def fusion_hydrate(spark, sf):
    return _hydrated(spark, sf).select("qid", "chunk_id", "doc_id", "section", "fused_rank")


def _reranked(spark, sf):
    return rerank.lexical_rerank(_hydrated(spark, sf), _questions(spark, sf), _index(spark, sf))


@query
def lexical_rerank(spark, sf):
    return _reranked(spark, sf).select("qid", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


@query
def rerank_topn(spark, sf):
    top = rerank.take_top(_reranked(spark, sf))
    return top.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def rerank_disabled(spark, sf):
    top = rerank.no_rerank(_hydrated(spark, sf))
    return top.select("qid", "chunk_id", F.round("score", 9).alias("score"), "rank")


# --- answering ------------------------------------------------------------------------


def _ranked(spark, sf):
    return rerank.take_top(_reranked(spark, sf))


@query
def relevance_gate(spark, sf):
    return answering.relevance(_questions(spark, sf), _ranked(spark, sf), answering.Gates(min_top_score=0.35))


@query
def coverage_gate(spark, sf):
    got = answering.coverage_gate(answering.question_coverage(_questions(spark, sf), _index(spark, sf)))
    return got.select("qid", F.round("coverage", 3).alias("coverage"), "reason")


@query
def context_budget(spark, sf):
    got = answering.context_blocks(_ranked(spark, sf), answering.Gates(max_chars_per_source=300, max_context_chars=900))
    return got.select("qid", "marker_no", "chunk_id", F.length("body").alias("n_chars"), "used")


@query
def render_context(spark, sf):
    blocks = answering.context_blocks(_ranked(spark, sf))
    rows = blocks.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("marker_no", "source", "section", "body"))).alias("b"))
    return rows.select("qid", answering.render_context(F.col("b")).alias("context"))


@query
def grounding(spark, sf):
    """Support of each stored answer in the chunks its question's citations name."""
    cited = _quotes(spark, sf).groupBy("qid").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("support"))
    known = cited.select("qid", F.array_distinct(T.lexical_tokens(F.col("support"))).alias("r"))  # once a question, not an answer
    answers = _results(spark, sf).where(F.col("answer").isNotNull() & ~F.col("abstained")).select(F.col("id").alias("qid"), "answer").distinct()
    rows = answers.join(known, "qid").select("qid", "answer", "r", T.lexical_tokens(T.without_markers(F.col("answer"))).alias("c"))
    return rows.select("qid", "answer", F.round(evaluation.overlap_ratio(F.col("c"), F.col("r")), 6).alias("grounding"))


@lru_cache(maxsize=4)
def _corpus(spark, sf):
    body = chunking.embedding_text(*[F.coalesce(F.col(c), F.lit("")) for c in ("title", "section", "text")])
    chunks = _chunks(spark, sf)
    embedder = dense.HashingEmbedder()
    return pipeline.Corpus(chunks, _index(spark, sf), dense.embed_texts(chunks, "chunk_id", body, embedder).persist(), embedder)


@query
def retrieve_hybrid(spark, sf):
    found = pipeline.retrieve(_corpus(spark, sf), _questions(spark, sf))
    return found.select("qid", "chunk_id", "fusion_score", "dense_rank", "lexical_rank", "retriever", "fused_rank")


@query
def answer_questions(spark, sf):
    """The flagship: every golden question answered from the chunk corpus, or refused with a reason."""
    got = pipeline.answer(_corpus(spark, sf), _questions(spark, sf))
    return got.select("qid", "text", "reason", "confidence", "grounding", F.size("citations").alias("n_citations"), "input_tokens", "output_tokens")


@query
def answer_citations(spark, sf):
    got = pipeline.answer(_corpus(spark, sf), _questions(spark, sf))
    return got.select("qid", F.inline("citations"))


# --- chunking ---------------------------------------------------------------------------


@query
def chunk_documents(spark, sf):
    return chunking.chunk_documents(_library(spark, sf)).drop("metadata")


@query
def chunk_statistics(spark, sf):
    c = chunking.chunk_documents(_library(spark, sf))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("token_count").alias("largest"), F.sum("token_count").alias("tokens"))


@query
def chunk_identity(spark, sf):
    """Chunk id, locator and embedding text from their parts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return _chunks(spark, sf).select(
        "chunk_id", chunking.chunk_id(F.col("doc_id"), F.col("ordinal")).alias("derived_id"),
        chunking.locator(F.col("source"), F.col("section")).alias("locator"),
        F.md5(chunking.embedding_text(text("title"), text("section"), text("text"))).alias("embedding_text_md5"),
    )


# --- maintenance --------------------------------------------------------------------------


def _manifest(spark, sf):
    """An older state: early documents, stale where the recorded length no longer fits the text."""
    old = read(spark, sf, "documents").where(F.col("ingested_at") < F.lit("2025-01-01").cast("timestamp"))
    fits = F.coalesce(F.col("n_chars") == F.length("text"), F.lit(False))
    return old.select("doc_id", F.when(fits, T.content_hash(F.col("text"))).otherwise(F.lit("stale")).alias("content_hash"))


@query
def incremental_diff(spark, sf):
    return maintenance.diff(read(spark, sf, "documents"), _manifest(spark, sf))


@query
def sync_classify(spark, sf):
    present = read(spark, sf, "documents").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    plan = maintenance.sync_plan(present, _manifest(spark, sf))
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


def _vector_like(df):
    return df.select("chunk_id", "doc_id", "section", F.length(F.coalesce("text", F.lit(""))).alias("n"))


@query
def upsert_chunks(spark, sf):
    """Early versions of all chunks, overwritten by those indexed late."""
    rows = read(spark, sf, "chunks")
    late = _vector_like(dedup(rows.where(F.col("indexed_at") >= F.lit("2025-02-01").cast("timestamp")), ["chunk_id"], "doc_id", "section", "text"))
    early = _vector_like(_chunks(spark, sf)).withColumn("n", F.lit(-1))
    return maintenance.upsert(early, late, "chunk_id")


@query
def delete_documents(spark, sf):
    gone = _library(spark, sf).where(F.trim(F.coalesce("text", F.lit(""))) == "")
    return maintenance.delete(_chunks(spark, sf), gone, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@query
def upload_validate(spark, sf):
    lib = _library(spark, sf)
    name = F.element_at(F.split("source", "/"), -1)
    files = lib.select("doc_id", name.alias("name"), "text", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))
    known = lib.select("doc_id", F.when(F.col("metadata")["owner"].isNotNull(), F.concat(F.lit("x-"), name)).otherwise(name).alias("name"))
    return maintenance.validate_uploads(files, known, 1200).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def library_listing(spark, sf):
    m = maintenance.manifest_of(_library(spark, sf), _chunks(spark, sf))
    return maintenance.listing(m).select("doc_id", "filename", "title", "content_hash", "chunks")


@query
def manifest_stats(spark, sf):
    return maintenance.stats(maintenance.manifest_of(_library(spark, sf), _chunks(spark, sf)))


@query
def unknown_documents(spark, sf):
    """Expected sources that are not in the library."""
    wanted = _items(spark, sf).select(F.explode("expected_sources").alias("doc_id"))
    return maintenance.unknown_ids(wanted, _library(spark, sf).select(F.col("source").alias("doc_id")))


# --- evaluation -----------------------------------------------------------------------------


@query
def hit_mrr(spark, sf):
    rows = evaluation.score_retrieval(_results(spark, sf))
    return rows.select("result_id", F.col("hit_at_1").cast("string"), F.col("recall_at_k").cast("string"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query
def citation_precision(spark, sf):
    rows = evaluation.score_citations(_results(spark, sf))
    return rows.select("result_id", F.round("citation_precision", 3).alias("citation_precision"), F.col("correct_source_cited").cast("string"))


@query
def headline_metrics(spark, sf):
    rows = evaluation.metrics_long(_results(spark, sf))
    return rows.select("metric", F.round("value", 3).alias("value"))


@query
def abstention_metrics(spark, sf):
    named = evaluation.headline_metrics()
    rows = _results(spark, sf).groupBy("run_id").agg(
        *[named[f"abstention.{m}"].alias(m) for m in ("abstention_recall", "abstention_precision", "false_abstention_rate")]
    )
    return rows.select("run_id", *[F.round(c, 3).alias(c) for c in rows.columns[1:]])


@query
def percentile_nearest_rank(spark, sf):
    return evaluation.nearest_rank(_results(spark, sf), ["run_id"], "latency_ms", [50, 95])


@query
def breakdown_by_dimension(spark, sf):
    rows = evaluation.breakdown(_results(spark, sf))
    return rows.select("dimension", "name", "n", *[F.round(c, 3).alias(c) for c in ("recall_at_k", "faithfulness", "answer_f1")], "abstained")


@query
def reason_histogram(spark, sf):
    return evaluation.reason_histogram(_results(spark, sf))


@query
def threshold_gate(spark, sf):
    rows = evaluation.threshold_checks(evaluation.metrics_long(_results(spark, sf)))
    return rows.select("metric", "bound", "limit_value", F.round("value", 3).alias("value"), "passed")


@query
def baseline_deltas(spark, sf):
    """Easy items against hard ones."""
    rows = _results(spark, sf).withColumn("d", F.lower(F.trim("difficulty")))
    easy, hard = (evaluation.metrics_long(rows.where(F.col("d") == d)) for d in ("easy", "hard"))
    got = evaluation.metric_deltas(hard, easy)
    return got.select("metric", *[F.round(c, 2).alias(c) for c in ("baseline", "current", "delta")])


@query
def notable_failures(spark, sf):
    return evaluation.notable_failures(_results(spark, sf)).groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.sum("result_id").alias("id_sum"))


@query
def judge_json_parse(spark, sf):
    """Scores from replies that wrap a JSON object in prose; a reply without one has none."""
    found = F.concat(F.lit('Verdict:\n{"reason": "as {cited}", "score": '), F.col("judge_score").cast("string"), F.lit("}\nDone."))
    reply = F.when(F.col("judge_score").isNull() | F.isnan("judge_score"), "No verdict.").otherwise(found)
    return _results(spark, sf).select("result_id", evaluation.judge_score(reply).alias("score"))


@query
def golden_validator(spark, sf):
    got = evaluation.validate_golden(_items(spark, sf), _library(spark, sf))
    return got.groupBy("level", "issue").agg(F.count(F.lit(1)).alias("n"))
