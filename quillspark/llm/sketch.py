"""Problem 1: percentiles of very large numeric columns from mergeable buckets.

Values are counted in signed logarithmic buckets of fixed relative width
(``gamma = (1 + a) / (1 - a)``); bucket counts of separate partitions, files or days are
added, and any percentile then comes out within relative error ``a`` of a value of that
rank.  A bucket also keeps its smallest and largest value, so a bucket
of one value is exact.  All of it is native aggregation with map-side combine: a row
leaves its task only as part of a bucket count, and the number of buckets of a group is
bounded by the range of DOUBLE, not by its rows.

NULL and NaN are not values. Infinities have buckets of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALPHA = 0.001
_ENDLESS = 1 << 30


def _gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def bucket_of(value: Column, alpha: float = ALPHA) -> tuple[Column, Column]:
    """Sign (-1, 0, 1) and index of a value's bucket."""
    size = F.abs(value)
    index = F.ceil(F.log(size) / math.log(_gamma(alpha))).cast("int")
    index = F.when(size == float("inf"), _ENDLESS).when(size == 0, 0).otherwise(index)
    return F.signum(value).cast("int"), index


def bucket_counts(df: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Sketch of every group: ``by, sign, bucket, n, lo, hi``. A table that can be kept."""
    sign, index = bucket_of(F.col(value).cast("double"), alpha)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return (
        rows.select(*by, sign.alias("sign"), index.alias("bucket"), F.col(value).cast("double").alias("v"))
        .groupBy(*by, "sign", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )


def merge_counts(parts: DataFrame, by: list[str]) -> DataFrame:
    """Add up sketches of separate pieces; drops any piece column that is not in ``by``."""
    return parts.groupBy(*by, "sign", "bucket").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def percentiles(sketch: DataFrame, by: list[str], pcts: list[float], alpha: float = ALPHA) -> DataFrame:
    """``by, pct, n, value``: the value of rank ``ceil(pct / 100 * n)`` within relative error ``alpha``.

    Groups without values are absent. ``pct`` 0 is the least value.
    """
    if any(not 0 <= p <= 100 for p in pcts):
        raise ValueError("a percentage is between 0 and 100")
    gamma = _gamma(alpha)
    order = Window.partitionBy(*by).orderBy("sign", F.col("sign") * F.col("bucket"))
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*by))
    middle = F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(
        F.col("sign") * F.pow(F.lit(gamma), F.col("bucket")) * (2 / (gamma + 1))
    )
    ranked = sketch.select(
        *by, "n", upto.alias("_upto"), total.alias("_total"), F.least(F.greatest(middle, "lo"), "hi").alias("value")
    ).withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts])))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("pct") * F.col("_total") / 100, 9)))
    return ranked.where((F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < rank)).select(
        *by, "pct", F.col("_total").alias("n"), "value"
    )
