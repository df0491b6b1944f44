"""Problem 2: one ranking from several differently-scaled scores.

A rank walk: from an item, pick one of the scores at random and draw an item of the group;
if the score ranks it higher, jump there, else stay.  A jump is so uniform over the
higher-ranked items, and how often an item is left falls with how many are above it, in
proportion: that keeps the mass from piling up on the leader of each score, where the
places behind it would be decided by who feeds it.  Only ranks matter, so no score
rules by its range.  The stationary probabilities, with damping, give the order.  One power
iteration needs no matrix: in each score's order the mass flowing into an item is a
suffix sum of the mass below it, so it costs one pass over the sorted items.

All groups of an Arrow batch iterate together in flat arrays.  Groups of more than
``group_limit`` items take the same walk, all of them together, as DataFrame steps: ranks by
range partitioning, suffix sums over blocks and then within them. Same damping, same
number of steps, same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_small, cut_lineage

DAMPING = 0.25
TOLERANCE = 1e-11  # of the mean probability of the group
MAX_STEPS = 200  # 18 at this damping: the change shrinks by it every step
GROUP_LIMIT = 500_000
BLOCK = 4096
DIGITS = 9  # of the probability times the group size; closer ones are equal


def walk(groups: np.ndarray, scores: np.ndarray, damping: float = DAMPING, steps: int = MAX_STEPS) -> np.ndarray:
    """Stationary probability of every item times the size of its group; ``groups`` are sorted group numbers from 0.

    ``scores`` is items x scores; NaN counts as the lowest of its group. Equal scores
    share a rank: none of them is higher than another.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0)
    scores = np.where(np.isnan(scores), -np.inf, scores)
    sizes = np.bincount(groups)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    last = first + sizes - 1
    size = sizes[groups].astype(float)
    plans, stay = [], np.zeros(n)
    for j in range(k):
        order = np.lexsort((-scores[:, j], groups))  # best first within each group
        s, g = scores[order, j], groups[order]
        tie = np.r_[True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])]
        run = np.cumsum(tie) - 1
        run_start = np.nonzero(tie)[0]
        run_end = np.r_[run_start[1:], n] - 1
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        stay += 1 - ((run_start[run] - first[g]) / size[order])[back]
        plans.append((order, back, run_end[run] + 1, last[g] + 1))
    p = np.ones(n)
    for _ in range(steps):
        flow = stay * p
        for order, back, below, group_end in plans:
            total = np.r_[0.0, np.cumsum(p[order])]
            flow += ((total[group_end] - total[below]) / size[order])[back]
        new = 1 - damping + damping * flow / k
        moved = np.abs(new - p).max()
        p = new
        if moved < TOLERANCE:
            break
    return p


def places(groups: np.ndarray, p: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Place from 1 in each group: highest probability first, then by name."""
    order = np.lexsort((names, -np.round(p, DIGITS), groups))
    first = np.r_[True, groups[order][1:] != groups[order][:-1]]
    at = np.arange(len(groups))
    out = np.empty(len(groups), np.int32)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
    return out


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group is cut."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        start = int(np.searchsorted((pdf["_g"] != pdf["_g"].iloc[-1]).to_numpy()[::-1], True))
        cut = len(pdf) - start
        if cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True) if held else pdf.iloc[:cut]
            held = [pdf.iloc[cut:]]
        elif held and held[-1]["_g"].iloc[-1] != pdf["_g"].iloc[0]:
            yield pd.concat(held, ignore_index=True)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def rank_walk(
    df: DataFrame,
    group: str,
    item: str,
    scores: list[str],
    damping: float = DAMPING,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """``group, item, place INT, weight``: one order of every group's items; the weights of a group have mean 1.

    Rows with NULL group or item are left out; repeated (group, item) rows count once
    (the greatest score of each kind). NULL and NaN scores are the lowest of the group.
    Exact ties are ordered by item. An empty input gives no rows.
    """
    if not scores:
        raise ValueError("at least one score is needed")
    columns = [f"_s{j}" for j in range(len(scores))]
    clean = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).cast("string").alias("_g"),
        F.col(item).cast("string").alias("_i"),
        *[F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(c) for s, c in zip(scores, columns, strict=True)],
    )
    items = clean.groupBy("_g", "_i").agg(*[F.max(c).alias(c) for c in columns])
    large = clean.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_limit).select("_g")
    schema = "_g string, _i string, place int, weight double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _segments(batches):
            groups = pd.factorize(pdf["_g"])[0]
            p = walk(groups, pdf[columns].to_numpy(float), damping)
            names = pd.factorize(pdf["_i"], sort=True)[0]
            yield pd.DataFrame({"_g": pdf["_g"], "_i": pdf["_i"], "place": places(groups, p, names), "weight": p})

    any_large = bool(large.take(1))
    if any_large:
        large = broadcast_small(large)
    small = items.join(large, "_g", "left_anti") if any_large else items
    out = small.repartition("_g").sortWithinPartitions("_g").mapInPandas(run, schema)
    if any_large:
        out = out.unionByName(_large_walk(items.join(large, "_g", "left_semi"), columns, damping))
    return out.select(F.col("_g").alias(group), F.col("_i").alias(item), "place", "weight")


def _numbered(df: DataFrame, keys: list[Column], out: str) -> DataFrame:
    """Position of every row in its group ``_g`` in a total order, and its part ``_p`` of the sorted rows.

    No task sees more than a part of the rows: parts are ranges of the order, however few groups there are.
    """
    parts = df.repartitionByRange(F.col("_g"), *keys).sortWithinPartitions("_g", *keys)
    parts = parts.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    parts = cut_lineage(parts.withColumn("_m", F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)))
    # One row per part and group: a group's rows follow each other, so its own place in the part is found from its first.
    starts = parts.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_f"))
    w = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_g", "_p", "_f", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_b"))
    placed = parts.join(broadcast_small(starts), ["_g", "_p"])
    return placed.withColumn(out, F.col("_m") - F.col("_f") + F.col("_b")).drop("_m", "_f", "_b")


def _below(ties: DataFrame) -> DataFrame:
    """``_g, _j, _a, _w``: the mass of the ties after each tie of a score, by sums of blocks and then within the blocks."""
    ties = ties.withColumn("_blk", F.floor(F.col("_a") / BLOCK))
    blocks = ties.groupBy("_g", "_j", "_blk").agg(F.sum("_v").alias("_s"))
    after = Window.partitionBy("_g", "_j").orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_g", "_j", "_blk", F.coalesce(F.sum("_s").over(after), F.lit(0.0)).alias("_after"))
    inside = Window.partitionBy("_g", "_j", "_blk").orderBy(F.col("_a").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inner = ties.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0.0)))
    return inner.join(blocks, ["_g", "_j", "_blk"]).select("_g", "_j", "_a", (F.col("_in") + F.col("_after")).alias("_w"))


def _large_walk(items: DataFrame, columns: list[str], damping: float, steps: int = MAX_STEPS) -> DataFrame:
    """The walk of all huge groups as DataFrame steps, lineage cut every step.

    A tie may hold any share of a group (missing scores do), so rows never meet by tie alone, but by the
    pieces ``_t`` of it that lie in one part of the sorted rows; sums go piece by piece, then tie by tie.
    """
    state, k = items, len(columns)
    for j, c in enumerate(columns):
        state = state.withColumn(c, F.coalesce(F.col(c), F.lit(float("-inf"))))
        state = _numbered(state, [F.col(c).desc(), F.col("_i")], "_at")
        pieces = state.groupBy("_g", "_p", c).agg(F.min("_at").alias(f"_t{j}"))
        whole = Window.partitionBy("_g", c)  # at most one row per part of the sorted rows
        pieces = pieces.withColumn(f"_a{j}", F.min(f"_t{j}").over(whole))
        state = cut_lineage(state.join(pieces, ["_g", "_p", c]).drop("_p", "_at", c))
    sizes = broadcast_small(state.groupBy("_g").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    stay = sum((1 - F.col(f"_a{j}") / F.col("_n") for j in range(k)), F.lit(0.0))
    state = cut_lineage(state.join(sizes, "_g").withColumn("_stay", stay).withColumn("p", F.lit(1.0)))
    places_of = [c for j in range(k) for c in (f"_t{j}", f"_a{j}")]
    for _ in range(steps):
        links = F.array(*[F.struct(F.lit(j).alias("_j"), F.col(f"_t{j}").alias("_t"), F.col(f"_a{j}").alias("_a")) for j in range(k)])
        long = state.withColumn("_l", F.explode(links)).select("*", "_l.*").drop("_l")
        pieces = long.groupBy("_g", "_j", "_t", "_a").agg(F.sum("p").alias("_v"))
        below = _below(pieces.groupBy("_g", "_j", "_a").agg(F.sum("_v").alias("_v")))
        below = pieces.drop("_v").join(below, ["_g", "_j", "_a"]).select("_g", "_j", "_t", "_w")
        kept = [F.first(c).alias(c) for c in ("_n", "_stay", "p", *places_of)]
        flow = long.join(below, ["_g", "_j", "_t"]).groupBy("_g", "_i").agg(F.sum("_w").alias("_w"), *kept)
        q = F.lit(1 - damping) + F.lit(damping / k) * (F.col("_stay") * F.col("p") + F.col("_w") / F.col("_n"))
        state = cut_lineage(flow.select("_g", "_i", "_n", "_stay", *places_of, q.alias("p"), F.abs(q - F.col("p")).alias("_moved")))
        moved = state.agg(F.max("_moved")).first()[0]
        state = state.drop("_moved")
        if moved is None or moved < TOLERANCE:
            break
    ranked = _numbered(state, [F.round("p", DIGITS).desc(), F.col("_i")], "_pos")
    return ranked.select("_g", "_i", (F.col("_pos") + 1).cast("int").alias("place"), F.col("p").alias("weight"))
