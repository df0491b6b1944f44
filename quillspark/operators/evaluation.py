"""Retrieval and answer metrics, breakdowns, gates and golden-set validation.

A metric that does not apply is NULL, never 0; the mean of nothing is 0.0; a ratio with an
empty denominator is 1.0.  All of it is conditional aggregation, so an evaluation of
any number of results is one pass with partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens, strip, topical_tokens

# --- fixed values: the quality gates of the profiles, (group, metric, bound, value) ---
THRESHOLDS = {
    "offline": [
        ("retrieval", "hit_at_1", "min", 0.86), ("retrieval", "recall_at_k", "min", 0.95), ("retrieval", "mrr", "min", 0.90),
        ("answer_quality", "faithfulness", "min", 0.90), ("answer_quality", "answer_f1", "min", 0.36),
        ("answer_quality", "citation_precision", "min", 0.72), ("answer_quality", "correct_source_cited_rate", "min", 0.86),
        ("answer_quality", "answer_citation_rate", "min", 1.0), ("abstention", "abstention_recall", "min", 0.90),
        ("abstention", "abstention_precision", "min", 0.65), ("abstention", "false_abstention_rate", "max", 0.10),
        ("operational", "latency_p95_ms", "max", 2000.0),
    ],
    "full-retrieval": [
        ("retrieval", "hit_at_1", "min", 0.85), ("retrieval", "recall_at_k", "min", 0.95), ("retrieval", "mrr", "min", 0.90),
        ("answer_quality", "faithfulness", "min", 0.90), ("answer_quality", "answer_f1", "min", 0.36),
        ("answer_quality", "citation_precision", "min", 0.75), ("answer_quality", "correct_source_cited_rate", "min", 0.88),
        ("answer_quality", "answer_citation_rate", "min", 1.0), ("abstention", "abstention_recall", "min", 0.90),
        ("abstention", "abstention_precision", "min", 0.65), ("abstention", "false_abstention_rate", "max", 0.10),
        ("operational", "latency_p95_ms", "max", 5000.0),
    ],
    "full": [
        ("retrieval", "hit_at_1", "min", 0.80), ("retrieval", "recall_at_k", "min", 0.92), ("retrieval", "mrr", "min", 0.85),
        ("answer_quality", "faithfulness", "min", 0.60), ("answer_quality", "answer_f1", "min", 0.35),
        ("answer_quality", "citation_precision", "min", 0.80), ("answer_quality", "correct_source_cited_rate", "min", 0.90),
        ("answer_quality", "answer_citation_rate", "min", 1.0), ("abstention", "abstention_recall", "min", 0.90),
        ("abstention", "abstention_precision", "min", 0.80), ("abstention", "false_abstention_rate", "max", 0.08),
        ("operational", "latency_p95_ms", "max", 25000.0),
    ],
}
MIN_OVERLAP, MIN_TERMS = 0.55, 4
# ---------------------------------------------------------------------------------


def overlap_ratio(candidate: Column, reference: Column) -> Column:
    """Share of the candidate's lexical tokens (with repetitions) that the reference has."""
    hits = F.size(F.filter(candidate, lambda t: F.array_contains(reference, t)))
    return F.when((F.size(candidate) > 0) & (F.size(reference) > 0), hits / F.size(candidate)).otherwise(0.0)


def token_f1(predicted: Column, reference: Column) -> Column:
    """F1 of two token multisets; both empty 1, one empty 0."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(
        F.array_intersect(predicted, reference), F.lit(0), lambda a, t: a + F.least(count(predicted, t), count(reference, t))
    )
    n, m = F.size(predicted), F.size(reference)
    return (
        F.when((n == 0) & (m == 0), 1.0)
        .when((n == 0) | (m == 0) | (common == 0), 0.0)
        .otherwise(2 * (common / n) * (common / m) / (common / n + common / m))
    )


def score_retrieval(results: DataFrame) -> DataFrame:
    """``hit_at_1, recall_at_k, reciprocal_rank`` over distinct retrieved sources in order."""
    sources = F.array_distinct("retrieved_sources")
    hits = F.filter(F.transform(sources, lambda s, i: F.when(F.array_contains("expected_sources", s), i + 1)), lambda r: r.isNotNull())
    applies = F.col("answerable") & (F.size("expected_sources") > 0)
    rank = F.when(F.size(hits) > 0, F.element_at(hits, F.when(F.size(hits) > 0, F.lit(1)).otherwise(F.lit(-1))))
    return results.withColumns({
        "hit_at_1": F.when(applies, F.coalesce(rank == 1, F.lit(False))),
        "recall_at_k": F.when(applies, rank.isNotNull()),
        "reciprocal_rank": F.when(applies, F.coalesce(1.0 / rank, F.lit(0.0))),
    })


def score_citations(results: DataFrame) -> DataFrame:
    """``citation_precision, correct_source_cited`` of answered, answerable items; citing any expected source is right."""
    cited = F.array_distinct("citations")
    good = F.size(F.filter(cited, lambda s: F.array_contains("expected_sources", s)))
    applies = F.col("answerable") & ~F.col("abstained") & (F.size("expected_sources") > 0)
    return results.withColumns({
        "citation_precision": F.when(applies, F.when(F.size(cited) > 0, F.round(good / F.size(cited), 4)).otherwise(0.0)),
        "correct_source_cited": F.when(applies, good > 0),
    })


def _mean(c: Column) -> Column:
    c = c.cast("double")
    return F.coalesce(F.round(F.avg(F.when(~F.isnan(c), c)), 4), F.lit(0.0))


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, 1.0).otherwise(F.round(numerator / denominator, 4))


def headline_metrics() -> dict[str, Column]:
    """Aggregates of item results, named ``group.metric``."""
    answerable, answered = F.col("answerable"), F.col("answerable") & ~F.col("abstained")
    among = lambda cond, c: F.when(cond, F.col(c))
    refused = ~answerable & F.col("abstained")
    false = answerable & F.col("abstained")
    return {
        "counts.total": F.count(F.lit(1)),
        "counts.answerable": F.count_if(answerable),
        "counts.unanswerable": F.count_if(~answerable),
        "counts.answered": F.count_if(answered),
        "counts.abstained": F.count_if(F.col("abstained")),
        "retrieval.hit_at_1": _mean(among(answerable, "hit_at_1")),
        "retrieval.recall_at_k": _mean(among(answerable, "recall_at_k")),
        "retrieval.mrr": _mean(among(answerable, "reciprocal_rank")),
        "answer_quality.faithfulness": _mean(among(answered, "faithfulness")),
        "answer_quality.answer_f1": _mean(among(answered, "answer_f1")),
        "answer_quality.citation_precision": _mean(among(answered, "citation_precision")),
        "answer_quality.correct_source_cited_rate": _mean(among(answered, "correct_source_cited")),
        "answer_quality.answer_citation_rate": _mean(F.when(answered, F.size("citations") > 0)),
        "answer_quality.llm_judge_faithfulness": F.round(F.avg(among(answered, "judge_score")), 4),
        "abstention.abstention_recall": _ratio(F.count_if(refused), F.count_if(~answerable)),
        "abstention.abstention_precision": _ratio(F.count_if(refused), F.count_if(F.col("abstained"))),
        "abstention.false_abstention_rate": _ratio(F.count_if(false), F.count_if(answerable)),
        "operational.mean_input_tokens": F.coalesce(F.avg("input_tokens"), F.lit(0.0)).cast("int"),
        "operational.mean_output_tokens": F.coalesce(F.avg("output_tokens"), F.lit(0.0)).cast("int"),
    }


def nearest_rank(results: DataFrame, by: list[str], value: str, pcts: list[float]) -> DataFrame:
    """``by, pct, value``: the value at index ``round_half_even(pct / 100 * (n - 1))``, rounded to 2.

    Exact, over value counts instead of collected values: equal values are one row, and
    a running sum per group finds the index. NULL and NaN are left out.
    """
    counts = results.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy(value)
    counts = counts.select(
        *by, F.col(value).alias("_v"), "_n",
        F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_all"),
    ).withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts])))
    index = F.least(F.rint(F.col("pct") / 100 * (F.col("_all") - 1)), F.col("_all") - 1)
    hit = counts.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index))
    return hit.select(*by, "pct", F.round("_v", 2).alias("value"))


def metrics_long(results: DataFrame) -> DataFrame:
    """One row per metric: ``metric, value``. A metric that was never judged is absent."""
    named = headline_metrics()
    wide = results.agg(*[c.cast("double").alias(k.replace(".", "__")) for k, c in named.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k.replace(".", "__")).alias("value")) for k in named])
    long = wide.select(F.inline(pairs))
    late = nearest_rank(results.withColumn("_g", F.lit(1)), ["_g"], "latency_ms", [50, 95]).select(
        F.format_string("operational.latency_p%d_ms", F.col("pct").cast("int")).alias("metric"), "value"
    )
    return long.unionByName(late).where(F.col("value").isNotNull())


def breakdown(results: DataFrame) -> DataFrame:
    """By difficulty and by category in one pass: ``dimension, name, n, recall_at_k, faithfulness, answer_f1, abstained``."""
    key = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown"))
    answered = F.col("answerable") & ~F.col("abstained")
    sides = F.array(
        F.struct(F.lit("difficulty").alias("dimension"), key("difficulty").alias("name")),
        F.struct(F.lit("category").alias("dimension"), key("category").alias("name")),
    )
    rows = results.select(F.inline(sides), "answerable", "abstained", "recall_at_k", "faithfulness", "answer_f1")
    return rows.groupBy("dimension", "name").agg(
        F.count(F.lit(1)).alias("n"),
        _mean(F.when(F.col("answerable"), F.col("recall_at_k"))).alias("recall_at_k"),
        _mean(F.when(answered, F.col("faithfulness"))).alias("faithfulness"),
        _mean(F.when(answered, F.col("answer_f1"))).alias("answer_f1"),
        F.count_if("abstained").alias("abstained"),
    )


def reason_histogram(results: DataFrame) -> DataFrame:
    return results.where(F.col("abstained") & (F.col("abstain_reason") != "")).groupBy("abstain_reason").agg(F.count(F.lit(1)).alias("n"))


def threshold_checks(metrics: DataFrame, profile: str = "offline") -> DataFrame:
    """``metric, bound, limit_value, value, passed``; bounds are inclusive and a missing metric fails."""
    if profile not in THRESHOLDS:
        raise ValueError(f"unknown profile {profile!r}; known: {sorted(THRESHOLDS)}")
    rows = [(f"{g}.{m}", b, v) for g, m, b, v in THRESHOLDS[profile]]
    limits = metrics.sparkSession.createDataFrame(rows, "metric string, bound string, limit_value double")
    ok = F.when(F.col("bound") == "min", F.col("value") >= F.col("limit_value")).otherwise(F.col("value") <= F.col("limit_value"))
    return limits.join(metrics.select("metric", "value"), "metric", "left").withColumn("passed", F.coalesce(ok, F.lit(False)))


def metric_deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``metric, baseline, current, delta`` of the quality metrics that both runs have."""
    before = baseline.select("metric", F.col("value").alias("baseline"))
    both = current.select("metric", F.col("value").alias("current")).join(before, "metric")
    both = both.where(F.split("metric", r"\.")[0].isin("retrieval", "answer_quality", "abstention"))
    return both.select("metric", "baseline", "current", F.round(F.col("current") - F.col("baseline"), 4).alias("delta"))


def notable_failures(results: DataFrame) -> DataFrame:
    """Results that went wrong, with ``issue``."""
    lost = F.coalesce(~F.col("recall_at_k"), F.lit(False))
    issue = (
        F.when(~F.col("answerable") & ~F.col("abstained"), "answered an unanswerable question")
        .when(F.col("answerable") & F.col("abstained"), F.concat(F.lit("false abstention ("), "abstain_reason", F.lit(")")))
        .when(F.col("answerable") & lost, "correct document not retrieved")
    )
    return results.withColumn("issue", issue).where(F.col("issue").isNotNull())


def judge_score(reply: Column) -> Column:
    """The score in a judge's reply, from the JSON object between its first and last brace.

    NULL if there is no object or it can't be read; 0.0 if the object has no score.
    """
    found = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    score = F.get_json_object(found, "$.score")
    return F.when(F.get_json_object(found, "$").isNotNull(), F.coalesce(score, F.lit("0")).try_cast("double"))


def judge(results: DataFrame, passages: DataFrame, complete, prompt) -> DataFrame:
    """``results`` with ``judge_score`` by a model: ``complete(system, user) -> reply``, asked about answered, answerable items only.

    ``passages`` has ``id, rank, text``; an item's context is its passages in order.
    """
    import pandas as pd

    context = passages.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda p: p["text"]), "\n\n").alias("context"))
    asked = results.where(F.col("answerable") & ~F.col("abstained")).select("result_id", "id", "question", "answer").join(context, "id")

    def run(batches):
        for pdf in batches:
            calls = (prompt.render(question=r.question, context=r.context, answer=r.answer) for r in pdf.itertuples())
            yield pd.DataFrame({"result_id": pdf["result_id"], "reply": [complete(*c) for c in calls]})

    kind = results.schema["result_id"].dataType.simpleString()
    replies = asked.mapInPandas(run, f"result_id {kind}, reply string").select("result_id", judge_score(F.col("reply")).alias("judge_score"))
    return results.drop("judge_score").join(replies, "result_id", "left")


def cross_check(results: DataFrame, outside: DataFrame, metric: str = "faithfulness", tolerance: float = 0.15) -> DataFrame:
    """``metric, n, own, outside, agree``: means of an outside scorer (``id, <metric>``) beside the engine's own, over items both scored."""
    both = results.where(F.col(metric).isNotNull()).select("id", F.col(metric).alias("own")).join(outside.select("id", F.col(metric).alias("out")), "id")
    got = both.where(F.col("out").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("own"), 4).alias("own"), F.round(F.avg("out"), 4).alias("outside"))
    return got.select(F.lit(metric).alias("metric"), "n", "own", "outside", (F.abs(F.col("own") - F.col("outside")) <= tolerance).alias("agree"))


def validate_golden(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """``id, level, issue`` of a golden set: required fields, duplicates, sources, vocabulary overlap.

    ``corpus`` has ``source, text``. Vocabulary is compared by joins on terms, never collected.
    """
    clean = items.select(
        F.coalesce("id", F.lit("<missing id>")).alias("id"), F.col("question"),
        F.coalesce("answerable", F.lit(True)).alias("answerable"),
        strip(F.coalesce("reference_answer", F.lit(""))).alias("reference"),
        F.coalesce("expected_sources", F.array().cast("array<string>")).alias("sources"),
    ).persist()
    blank = F.coalesce(F.col("question"), F.lit("")) == ""
    checks = [
        (F.col("id") == "<missing id>", "error", "missing required field 'id'"),
        (blank, "error", "missing required field 'question'"),
        (F.col("answerable") & (F.col("reference") == ""), "error", "answerable row has no reference_answer"),
        (F.col("answerable") & (F.size("sources") == 0), "error", "answerable row has no expected_sources"),
        (~F.col("answerable") & (F.col("reference") != ""), "error", "unanswerable row must have an empty reference_answer"),
        (~F.col("answerable") & (F.size("sources") > 0), "error", "unanswerable row must have no expected_sources"),
    ]
    found = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(issue).alias("issue"))) for c, level, issue in checks])
    )
    issues = clean.select("id", F.inline(found))
    same = lambda key, level, issue: (
        clean.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where(F.col("n") > 1)
        .select("id", F.lit(level).alias("level"), F.lit(issue).alias("issue"))
    )
    issues = issues.unionByName(same(F.col("id"), "error", "duplicate id"))
    issues = issues.unionByName(same(F.lower(strip(F.coalesce("question", F.lit("")))), "warning", "duplicate question text"))
    texts = corpus.where(F.col("source").isNotNull()).dropDuplicates(["source"])
    vocab = texts.select("source", F.explode(F.array_distinct(lexical_tokens(F.coalesce("text", F.lit(""))))).alias("term")).persist()
    wanted = clean.where(F.col("answerable")).select("id", "reference", F.explode("sources").alias("source"))
    missing = wanted.join(texts.select("source"), "source", "left_anti")
    issues = issues.unionByName(
        missing.select("id", F.lit("error").alias("level"), F.concat(F.lit("expected source does not exist: "), "source").alias("issue"))
    )
    terms = wanted.select("id", "source", F.explode(lexical_tokens(F.col("reference"))).alias("term"))
    per_term = terms.groupBy("id", "source", "term").agg(F.count(F.lit(1)).alias("n"))
    hit = per_term.join(vocab.withColumn("hit", F.lit(1)), ["source", "term"], "left")
    union = hit.groupBy("id", "term").agg(F.max("n").alias("n"), F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    low = union.groupBy("id").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("hit")).alias("got"))
    exists = wanted.join(texts.select("source"), "source", "left_semi").select("id").distinct()
    low = low.where((F.col("all") >= MIN_TERMS) & (F.col("got") / F.col("all") < MIN_OVERLAP)).join(exists, "id", "left_semi")
    issues = issues.unionByName(low.select("id", F.lit("error").alias("level"), F.lit("reference answer is not supported by its sources").alias("issue")))
    asked = clean.where(~F.col("answerable")).select("id", F.explode(F.array_distinct(topical_tokens(F.coalesce("question", F.lit(""))))).alias("term"))
    known = asked.join(vocab.select("term").distinct().withColumn("hit", F.lit(1)), "term", "left")
    covered = known.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("got"))
    return issues.unionByName(
        covered.where(F.col("n") == F.col("got")).select("id", F.lit("warning").alias("level"), F.lit("every topical term is in the corpus").alias("issue"))
    )


def exit_code(checks: DataFrame, gate: bool = True) -> int:
    """0 if every bound holds or gating is off, else 1."""
    return int(gate and not checks.where(~F.col("passed")).isEmpty())
