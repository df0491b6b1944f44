"""Problem 8: mixing sources to target weights.

Each source of the targets has ``target_share`` of the total size; a document of it then
needs ``copies = target / available`` on average, at most ``max_repeats``.  The whole part
is given to every document, the fraction by pivotal dependent rounding: two fractional
documents meet, mass moves at random from one to the other until one is whole, and the
other goes on.  Each partition does so by itself over its documents in order of
size, which keeps the rounded size close to the target, and leaves one fractional document
per source; these residuals meet in a reduction tree of fixed fan-in.  So no
source is ever gathered in one task, however many rows it has.

The random numbers are hashes of seed and document, so a partition that is computed again
gives the same copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..session import broadcast_small, cut_lineage

FAN_IN = 32
SEED = 42
_EPS = 1e-9


def chance(seed: int, key: str) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(a: float, b: float, u: float) -> tuple[float, float]:
    """Two fractions after their meeting; one of them is 0 or 1, each keeps its mean."""
    s = a + b
    if s < 1:
        return (0.0, s) if u * s < b else (s, 0.0)
    return (1.0, s - 1) if u * (2 - s) < 1 - b else (s - 1, 1.0)


class Pivot:
    """Sequential pivotal rounding that holds one fractional document per source."""

    def __init__(self, seed: int) -> None:
        self.seed, self.held = seed, {}

    def meet(self, source: str, doc: object, fraction: float, row: tuple) -> Iterator[tuple[tuple, float]]:
        """Yields ``row, 0 or 1`` of documents that became whole."""
        if fraction <= _EPS or fraction >= 1 - _EPS:
            yield row, float(round(fraction))
            return
        if source not in self.held:
            self.held[source] = (row, fraction)
            return
        other, g = self.held.pop(source)
        g, f = pivot(g, fraction, chance(self.seed, str(doc)))
        for r, x in ((other, g), (row, f)):
            if x <= _EPS or x >= 1 - _EPS:
                yield r, float(round(x))
            else:
                self.held[source] = (r, x)

    def rest(self) -> Iterator[tuple[tuple, float]]:
        yield from self.held.values()


def normal_source(c):
    return F.lower(strip(c))


def mixture_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: ``available, documents, target_tokens, rate``; sizes in ``tokens``.

    Sources of the targets without documents have 0 available; documents of other
    sources (or none) take no part. A source listed twice counts once.
    """
    goal = targets.select(
        normal_source(F.col("source")).alias("source"), "target_share", "max_repeats"
    ).where(F.col("source").isNotNull()).dropDuplicates(["source"])
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    plan = goal.join(have, "source", "left").fillna(0, ["available", "documents"])
    plan = plan.withColumn("total", F.sum("available").over(Window.partitionBy(F.lit(1))))
    target = F.col("target_share") * F.col("total")
    return plan.select(
        "source", "target_share", "max_repeats", "available", "documents", "total", target.alias("target_tokens"),
        F.least(
            F.col("max_repeats").cast("double"),
            F.when(F.col("available") > 0, target / F.col("available")).otherwise(F.lit(0.0)),
        ).alias("rate"),
    )


def _combiner(seed: int, level: int, fan_in: int, last: bool):
    """Meeting of the residuals of up to ``fan_in`` places of one source."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Pivot(seed + level), []
        pdf = pdf.sort_values(["tokens", "doc_id"])
        place = int(pdf["place"].min()) // fan_in
        for d, s, t, c, f, _ in pdf.itertuples(index=False):
            out += [(*r[:3], r[3] + int(x), None, place) for r, x in state.meet(s, d, f, (d, s, t, c))]
        for r, x in state.rest():
            if last:  # nobody is left to meet: a chance of its own fraction
                out.append((*r[:3], r[3] + int(chance(seed - 1, str(r[0])) < x), None, place))
            else:
                out.append((*r, x, place))
        return pd.DataFrame(out, columns=pdf.columns)

    return combine


def mixture(sized: DataFrame, plan: DataFrame, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, source, tokens, copies`` of every document of a planned source.

    ``sized`` has ``doc_id, source, tokens``. NULL sources take no part; documents of
    size 0 are treated like any other.
    """
    rates = broadcast_small(plan.select("source", "rate", F.col("max_repeats").cast("int").alias("most")))
    kind = sized.schema["doc_id"].dataType.simpleString()
    rows = sized.join(rates, "source").select("doc_id", "source", "tokens", "rate", "most")
    schema = f"doc_id {kind}, source string, tokens bigint, copies int, fraction double, place int"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        state = Pivot(seed)
        names = ["doc_id", "source", "tokens", "copies", "fraction", "place"]
        for pdf in batches:
            out = []
            for d, s, t, rate, most in pdf.itertuples(index=False):
                whole = min(int(rate + _EPS), most)
                row = (d, s, t, whole)
                for r, x in state.meet(s, d, min(max(0.0, rate - whole), most - whole), row):
                    out.append((*r[:3], r[3] + int(x), None, place))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(*r, x, place) for r, x in state.rest()], columns=names)

    settled = cut_lineage(rows.sortWithinPartitions("source", "tokens", "doc_id").mapInPandas(first, schema))
    done = settled.where(F.col("fraction").isNull())
    open_rows = settled.where(F.col("fraction").isNotNull())
    left = settled.rdd.getNumPartitions()
    level = 0
    while True:
        level += 1
        last = left <= fan_in

        combine = _combiner(seed, level, fan_in, last)
        step = open_rows.groupBy("source", F.floor(F.col("place") / fan_in)).applyInPandas(combine, schema)
        if last:
            done = done.unionByName(step)
            break
        step = cut_lineage(step)
        done = done.unionByName(step.where(F.col("fraction").isNull()))
        open_rows, left = step.where(F.col("fraction").isNotNull()), -(-left // fan_in)
    return done.select("doc_id", "source", "tokens", "copies")


def mixture_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target and reached share, and ``limited`` if the cap on repeats stops it short."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("tokens")).alias("reached_tokens"),
        F.min("copies").alias("least_copies"),
    )
    report = plan.join(got, "source", "left").fillna(0, ["reached_tokens"])
    report = report.withColumn("mixture_tokens", F.sum("reached_tokens").over(Window.partitionBy(F.lit(1))))
    full = F.coalesce(F.col("least_copies") >= F.col("max_repeats"), F.lit(True))
    return report.select(
        "source", "target_share", "available", "documents", "target_tokens", "reached_tokens",
        F.when(F.col("total") > 0, F.col("reached_tokens") / F.col("total")).alias("reached_of_total"),
        F.when(F.col("mixture_tokens") > 0, F.col("reached_tokens") / F.col("mixture_tokens")).alias("reached_share"),
        (full & (F.col("reached_tokens") < F.col("target_tokens"))).alias("limited"),
    )
