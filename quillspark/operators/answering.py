"""Gates, context, extractive answers, citations and confidence, for many questions at once.

The whole chain is a plan over tables: gates drop questions before any generator sees
them, sentences of all passages are scored as rows, and only what belongs to one
question (at most ``top_n`` passages within the context budget, so bounded by configuration) is ever
gathered into one row.  Python runs only in generators that call a model.  Between the stages the few rows of a
question are written to the checkpoint folder, which keeps the plans small and each passage tokenised once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sentences import best_sentences, claims, split_sentences
from ..functions.text import MARKER, is_numeric_question, lexical_tokens, strip, topical_tokens, truncate, without_markers
from ..session import cut_lineage
from .evaluation import overlap_ratio
from .rerank import term_weights
from .sparse import SparseIndex

REASONS = (
    "no_results", "low_relevance", "question_not_covered", "empty_response", "model_refusal", "no_citations", "low_grounding",
)


@dataclass(frozen=True)
class Gates:
    """Thresholds of a profile. The offline profile is the default."""

    min_top_score: float = 0.10
    min_question_coverage: float = 0.60
    min_grounding: float = 0.30
    min_sources: int = 1
    require_citations: bool = True
    refusal_marker: str = "INSUFFICIENT_EVIDENCE"
    refusal_message: str = "I don't have enough evidence to answer that."
    max_chars_per_source: int = 2000
    max_context_chars: int = 12000
    quote_chars: int = 320


PROFILES = {
    "offline": Gates(),
    "full-retrieval": Gates(min_top_score=-10.0),
    "full": Gates(min_top_score=-10.0, min_question_coverage=0.45),
}


# --- gates before generation ---------------------------------------------------


def relevance(questions: DataFrame, ranked: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """``qid, retrieved_n, eligible_n, reason``: ``no_results``, ``low_relevance`` or NULL."""
    counts = ranked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("retrieved_n"), F.count_if(F.round("score", 9) >= gates.min_top_score).alias("eligible_n")
    )
    out = questions.select("qid").join(counts, "qid", "left").fillna(0, ["retrieved_n", "eligible_n"])
    return out.withColumn(
        "reason",
        F.when(F.col("retrieved_n") == 0, "no_results").when(F.col("eligible_n") < gates.min_sources, "low_relevance"),
    )


def question_coverage(questions: DataFrame, index: SparseIndex | None) -> DataFrame:
    """``qid, coverage``: weight of the topical terms that the corpus has. 1.0 without terms or index."""
    weights = term_weights(questions, index, topical_tokens(F.col("question")))
    ratio = F.round(F.col("known_weight") / F.col("total_weight"), 4) if index is not None and index.ndocs else F.lit(1.0)
    return questions.select("qid").join(weights.select("qid", ratio.alias("coverage")), "qid", "left").fillna(1.0, ["coverage"])


def coverage_gate(coverage: DataFrame, gates: Gates = Gates()) -> DataFrame:
    low = (F.lit(gates.min_question_coverage) > 0) & (F.col("coverage") < gates.min_question_coverage)
    return coverage.withColumn("reason", F.when(low, "question_not_covered"))


def context_blocks(ranked: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Eligible passages as numbered blocks within the context budget; the first is always kept."""
    order = Window.partitionBy("qid").orderBy("rank")
    eligible = ranked.where(F.round("score", 9) >= gates.min_top_score)
    blocks = eligible.withColumn("marker_no", F.row_number().over(order)).withColumn(
        "body", truncate(F.coalesce("text", F.lit("")), gates.max_chars_per_source)
    )
    used = F.sum(F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("used", used).where((F.col("marker_no") == 1) | (F.col("used") <= gates.max_context_chars))


def render_context(blocks: Column) -> Column:
    """Context string of an array of blocks (marker_no, source, section, body)."""
    one = lambda b: F.concat(
        F.lit("[S"), b["marker_no"].cast("string"), F.lit("] source: "), F.coalesce(b["source"], F.lit("")),
        F.when(F.coalesce(b["section"], F.lit("")) != "", F.concat(F.lit(" | section: "), b["section"])).otherwise(F.lit("")),
        F.lit("\n"), b["body"],
    )
    return F.array_join(F.transform(blocks, one), "\n\n")


# --- generators -----------------------------------------------------------------

LIST_MARK = r"^\s*(?:[-*+]|\d+[.)])\s+"
ENDED = r"[.!?][\"'*_)\]]*$"
MADE = "qid string, made string, input_tokens int, output_tokens int, model string, latency_ms double"


@dataclass
class Generated:
    text: str | None
    input_tokens: int = 0
    output_tokens: int = 0
    model: str = ""


def sentence_score(tokens: Column, wanted: Column, bonus: Column) -> Column:
    """Coverage and density of a sentence; a digit helps a question for a number; under four terms count half."""
    n = F.size(tokens)
    coverage = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokens)) / F.size(wanted)).otherwise(0.0)
    density = F.size(F.filter(tokens, lambda t: F.array_contains(wanted, t))) / F.sqrt(n)
    score = 0.7 * coverage + 0.3 * F.least(density, F.lit(1.0)) + F.when(bonus, 0.15).otherwise(0.0)
    return F.when(n == 0, 0.0).when(n < 4, score * 0.5).otherwise(score)


@dataclass
class ExtractiveGenerator:
    """Quotes the sentences that cover the question best, each with its marker."""

    max_sentences: int = 3
    min_relevance: float = 0.12
    marginal_ratio: float = 0.65
    model: str = "extractive-v1"

    def candidates(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """``qid, marker_no, pos, sentence, hits, score`` of every sentence that has anything to say."""
        wanted = asked.select(
            "qid", F.array_distinct(topical_tokens(F.col("question"))).alias("wanted"), is_numeric_question(F.col("question")).alias("numeric")
        )
        rows = blocks.select("qid", "marker_no", F.posexplode(split_sentences(F.col("body"))).alias("pos", "raw"))
        rows = rows.where(~F.col("raw").rlike(r"^(?:\||```|~~~|#)")).withColumn("sentence", F.regexp_replace("raw", LIST_MARK, ""))
        rows = rows.where(F.col("sentence") != "").withColumn("tokens", lexical_tokens(F.col("sentence")))
        rows = cut_lineage(rows).join(wanted, "qid")  # else each use of the tokens would stem them anew
        bonus = F.col("numeric") & F.col("sentence").rlike(r"\d")
        rows = rows.withColumn("score", sentence_score(F.col("tokens"), F.col("wanted"), bonus)).where(F.col("score") > 0)
        return rows.select("qid", "marker_no", "pos", "sentence", F.array_intersect("wanted", "tokens").alias("hits"), "score")

    def _picked(self, ranked: Column) -> Column:
        """Sentences that add terms, from the best on: one new term, or two where the passage is quoted already."""
        floor = F.greatest(F.lit(self.min_relevance), ranked[0]["score"] * self.marginal_ratio)

        def step(state: Column, c: Column) -> Column:
            need = F.when(F.exists(state["chosen"], lambda x: x["marker_no"] == c["marker_no"]), 2).otherwise(1)
            adds = (F.size(state["chosen"]) == 0) | (F.size(F.array_except(c["hits"], state["covered"])) >= need)
            take = adds & (F.size(state["chosen"]) < self.max_sentences)
            quoted = F.struct(c["marker_no"].alias("marker_no"), F.size(state["chosen"]).alias("at"), c["sentence"].alias("sentence"))
            return F.struct(
                F.when(take, F.concat(state["chosen"], F.array(quoted))).otherwise(state["chosen"]).alias("chosen"),
                F.when(take, F.array_union(state["covered"], c["hits"])).otherwise(state["covered"]).alias("covered"),
            )

        start = F.struct(
            F.array().cast("array<struct<marker_no:int,at:int,sentence:string>>").alias("chosen"), F.array().cast("array<string>").alias("covered")
        )
        return F.aggregate(F.filter(ranked, lambda c: c["score"] >= floor), start, step, lambda state: F.sort_array(state["chosen"]))

    def write(self, asked: DataFrame, blocks: DataFrame, gates: Gates) -> DataFrame:
        """The refusal marker where no sentence is relevant enough."""
        order = F.struct((-F.col("score")).alias("neg"), "marker_no", "pos", "sentence", "hits", "score")
        found = self.candidates(asked, blocks).groupBy("qid").agg(F.sort_array(F.collect_list(order)).alias("ranked"))
        found = found.where(F.col("ranked")[0]["score"] >= self.min_relevance).select("qid", self._picked(F.col("ranked")).alias("picked"))
        full = lambda s: (
            F.when(s.rlike("[:;]$"), F.concat(F.regexp_replace(s, "[:;]$", ""), F.lit("."))).when(s.rlike(ENDED), s).otherwise(F.concat(s, F.lit(".")))
        )
        quote = lambda p: F.concat(full(p["sentence"]), F.lit(" [S"), p["marker_no"].cast("string"), F.lit("]"))
        found = found.select("qid", F.array_join(F.transform("picked", quote), " ").alias("text"))
        read = blocks.groupBy("qid").agg(F.sum(F.size("terms")).cast("int").alias("read"))
        made = asked.select("qid").join(found, "qid", "left").join(read, "qid", "left")
        said = F.col("text").isNotNull()
        return made.select(
            "qid", F.coalesce("text", F.lit(gates.refusal_marker)).alias("made"), F.when(said, F.coalesce("read", F.lit(0))).otherwise(0).alias("input_tokens"),
            F.when(said, F.size(lexical_tokens(F.col("text")))).otherwise(0).alias("output_tokens"), F.lit(self.model).alias("model"),
            F.lit(None).cast("double").alias("latency_ms"),
        )


@dataclass
class ScriptedGenerator:
    """Says the same whatever is asked; for tests of the gates."""

    text: str | None
    model: str = "scripted"
    calls: list = field(default_factory=list)

    def write(self, asked: DataFrame, blocks: DataFrame, gates: Gates) -> DataFrame:
        return asked.select(
            "qid", F.lit(self.text).cast("string").alias("made"), F.lit(100).alias("input_tokens"), F.lit(20).alias("output_tokens"),
            F.lit(self.model).alias("model"), F.lit(None).cast("double").alias("latency_ms"),
        )


def written_by(generate, asked: DataFrame, blocks: DataFrame, gates: Gates) -> DataFrame:
    """Texts of a model: ``generate(question, [(marker_no, body)], gates) -> Generated``, timed, one call a question."""
    per_q = blocks.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("marker_no", "body"))).alias("blocks"))
    rows = asked.select("qid", F.coalesce("question", F.lit("")).alias("question")).join(per_q, "qid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            out = []
            for qid, question, bs in pdf.itertuples(index=False):
                began = time.perf_counter()
                made = generate(question, [(int(b["marker_no"]), b["body"]) for b in bs], gates)
                out.append((qid, made.text, made.input_tokens, made.output_tokens, made.model, (time.perf_counter() - began) * 1000))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MADE.split(", ")])

    return rows.mapInPandas(run, MADE)


# --- validation, grounding, citations ---------------------------------------------


def validated(made: Column, known: Column) -> tuple[Column, Column]:
    """Text without markers of passages that were never given, and the numbers of the valid ones in order of use.

    ``known`` are the given markers as strings; ``S01`` is not ``S1``.
    """
    said = F.regexp_extract_all(made, F.lit("(?i)" + MARKER), 1)
    used = F.array_distinct(F.filter(said, lambda n: F.array_contains(known, n)))
    strange = F.array_distinct(F.filter(said, lambda n: ~F.array_contains(known, n)))
    drop = lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?i)\[\s*S"), n, F.lit(r"\s*\]")), F.lit(""))
    cleaned = strip(F.regexp_replace(F.aggregate(strange, made, drop), r"[ \t]{2,}", " "))
    return F.when(F.size(strange) > 0, cleaned).otherwise(made), F.transform(used, lambda n: n.cast("int"))


def finish(asked: DataFrame, blocks: DataFrame, made: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Answer rows from what a generator wrote: the first failing gate wins."""
    one = F.struct("marker_no", "body", "chunk_id", "source", "title", "section", F.col("score").cast("double").alias("score"), "retriever", "terms")
    given = blocks.groupBy("qid").agg(F.sort_array(F.collect_list(one)).alias("blocks"))
    rows = asked.select("qid", "question").join(made, "qid").join(given, "qid").withColumn("said", strip(F.coalesce("made", F.lit(""))))
    text, used = validated(F.col("said"), F.transform("blocks", lambda b: b["marker_no"].cast("string")))
    rows = rows.withColumns({"text": text, "used": used})
    rows = rows.withColumn("cited", F.transform("used", lambda n: F.element_at(F.filter("blocks", lambda b: b["marker_no"] == n), 1)))
    shown = F.when(F.size("cited") > 0, F.col("cited")).otherwise(F.col("blocks"))
    rows = rows.withColumns({
        "_prose": lexical_tokens(without_markers(F.col("text"))),
        "_support": F.array_distinct(F.flatten(F.transform(shown, lambda b: b["terms"]))),
    })
    rows = cut_lineage(rows)
    rows = rows.withColumn("grounding", F.round(overlap_ratio(F.col("_prose"), F.col("_support")), 4)).drop("_prose", "_support")
    reason = (
        F.when(F.col("said") == "", "empty_response")
        .when(F.col("said").contains(gates.refusal_marker), "model_refusal")
        .when(F.lit(gates.require_citations) & (F.size("used") == 0), "no_citations")
        .when(F.col("grounding") < gates.min_grounding, "low_grounding")
    )
    rows = rows.withColumn("reason", reason)
    # Each cited passage is quoted by its sentence closest to the claim it stands for.
    wanted = rows.where(F.col("reason").isNull()).withColumn("claims", claims(F.col("text")))
    wanted = wanted.select("qid", "question", "claims", F.posexplode("cited").alias("at", "b"))
    claim = F.col("claims")[F.concat(F.lit("S"), F.col("b.marker_no").cast("string"))]
    wanted = wanted.withColumn("_claim", F.coalesce(F.when(claim != "", claim), F.coalesce("question", F.lit(""))))
    quotes = best_sentences(wanted, ["qid", "at", "b"], F.col("_claim"), F.col("b.body"), "quote")
    citation = F.struct(
        F.concat(F.lit("S"), F.col("b.marker_no").cast("string")).alias("marker"), F.col("b.chunk_id").alias("chunk_id"), F.col("b.source").alias("source"),
        F.col("b.title").alias("title"), F.col("b.section").alias("section"), truncate(F.col("quote"), gates.quote_chars).alias("quote"), F.col("b.score").alias("score"),
    )
    quoted = quotes.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("at", citation.alias("c")))).alias("cs"))
    rows = rows.join(quoted.select("qid", F.col("cs.c").alias("citations")), "qid", "left")
    n = F.size("cited")
    agree = F.when(n > 0, F.size(F.filter("cited", lambda b: b["retriever"] == "hybrid")) / n).otherwise(0.0)
    sure = F.round(F.least(F.lit(1.0), 0.5 * F.col("grounding") + 0.25 * F.least(n / 2, F.lit(1.0)) + 0.25 * agree), 4)
    fine, low = F.col("reason").isNull(), F.col("reason") == "low_grounding"
    return rows.select(
        "qid", F.when(fine, F.col("text")).otherwise(F.lit(gates.refusal_message)).alias("text"), "reason", F.when(fine, sure).otherwise(0.0).alias("confidence"),
        F.when(fine | low, F.col("grounding")).otherwise(0.0).alias("grounding"), F.coalesce("citations", F.array().cast(CITATIONS)).alias("citations"),
        "input_tokens", "output_tokens", "model", "latency_ms",
    )


CITATIONS = "array<struct<marker:string,chunk_id:string,source:string,title:string,section:string,quote:string,score:double>>"
RETRIEVED = "array<struct<rank:int,chunk_id:string,source:string,title:string,section:string,score:double,retriever:string>>"


def answer_questions(
    questions: DataFrame, ranked: DataFrame, index: SparseIndex | None, gates: Gates = Gates(), generator=None
) -> DataFrame:
    """One row per question: a cited answer, or the refusal message with a reason; either with what was ``retrieved``.

    ``ranked`` has ``qid, chunk_id, source, title, section, text, score, rank, retriever``. ``latency_ms`` is the time of
    the model's call, NULL without one.
    """
    generator = generator or ExtractiveGenerator()
    first = relevance(questions, ranked, gates).select("qid", F.col("reason").alias("r1"))
    second = coverage_gate(question_coverage(questions, index), gates).select("qid", F.col("reason").alias("r2"))
    gated = questions.select("qid", "question").join(first, "qid").join(second, "qid").withColumn("reason", F.coalesce("r1", "r2"))
    gated = cut_lineage(gated)
    asked = gated.where(F.col("reason").isNull()).select("qid", "question")
    # A few passages per question, read by several stages; their terms are taken once.
    blocks = context_blocks(ranked, gates).join(asked.select("qid"), "qid", "left_semi").withColumn("terms", lexical_tokens(F.col("body")))
    blocks = cut_lineage(blocks)
    answered = finish(asked, blocks, generator.write(asked, blocks, gates), gates)
    refused = gated.where(F.col("reason").isNotNull()).select(
        "qid", F.lit(gates.refusal_message).alias("text"), "reason", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("grounding"),
        F.array().cast(CITATIONS).alias("citations"), F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit("").alias("model"),
        F.lit(None).cast("double").alias("latency_ms"),
    )
    seen = F.struct("rank", "chunk_id", "source", "title", "section", F.col("score").cast("double").alias("score"), "retriever")
    retrieved = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(seen)).alias("retrieved"))
    both = answered.unionByName(refused).join(retrieved, "qid", "left")
    return both.withColumn("retrieved", F.coalesce("retrieved", F.array().cast(RETRIEVED)))
