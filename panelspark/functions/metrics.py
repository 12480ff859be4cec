"""Return-series metrics as aggregate expressions and small relational helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.crosssection import with_average_ranks
from panelspark.functions.scalar import col
from panelspark.functions.windows import compounded, running_max

PERIODS_PER_YEAR = 252


def sharpe(returns, periods: int = PERIODS_PER_YEAR) -> Column:
    """Annualised mean over sample deviation; null when the deviation is 0 or undefined."""
    r = col(returns)
    return F.try_divide(F.avg(r), F.stddev_samp(r)) * F.lit(math.sqrt(periods))


def sortino(returns, periods: int = PERIODS_PER_YEAR) -> Column:
    r = col(returns)
    downside = F.stddev_samp(F.when(r < 0, r))
    return F.try_divide(F.avg(r), downside) * F.lit(math.sqrt(periods))


def hit_rate(returns) -> Column:
    r = col(returns)
    return F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0))


def compound(returns) -> Column:
    """Aggregate ``prod(1 + r) - 1``."""
    return F.product(F.lit(1.0) + col(returns)) - F.lit(1.0)


def drawdown_of_returns(df: DataFrame, returns: str, order, keys=(), out: str = "max_drawdown") -> DataFrame:
    """Deepest fall of the compounded curve below its running peak, one row per key.

    The peak starts at the first equity value. The input has one row per date and key.
    """
    curve = df.select(*keys, *order, compounded(returns, order, keys).alias("__equity"))
    peaks = curve.withColumn("__peak", running_max("__equity", order, keys))
    fall = F.try_divide(F.col("__equity"), F.col("__peak")) - F.lit(1.0)
    return peaks.groupBy(*keys).agg(F.min(fall).alias(out))


def drawdown_of_values(df: DataFrame, value: str, order, keys=(), out: str = "max_drawdown") -> DataFrame:
    """As :func:`drawdown_of_returns` for a value series; 0 when there are no values."""
    peaks = df.withColumn("__peak", running_max(value, order, keys))
    fall = F.try_divide(F.col(value), F.col("__peak")) - F.lit(1.0)
    return peaks.groupBy(*keys).agg(F.coalesce(F.min(fall), F.lit(0.0)).alias(out))


def information_coefficient(
    df: DataFrame, keys, prediction: str, realised: str, out: str = "ic",
    tie_break=("date", "symbol"), stored: bool = False,
) -> DataFrame:
    """Spearman correlation per group over rows where both values are present. ``stored`` says that the rows need not be stored."""
    rows = df.filter(F.col(prediction).isNotNull() & F.col(realised).isNotNull())
    rows = rows.select(*dict.fromkeys([*keys, *tie_break, prediction, realised]))
    if not keys:
        rows, keys_used = rows.withColumn("__all", F.lit(1)), ["__all"]
    else:
        keys_used = list(keys)
    ranked = with_average_ranks(
        rows, keys_used, {"__p": (prediction, True), "__y": (realised, True)}, tie_break, stored
    )
    scored = ranked.groupBy(*keys_used).agg(
        F.when(
            (F.stddev_pop("__p") > 0) & (F.stddev_pop("__y") > 0), F.corr("__p", "__y")
        ).alias(out)
    )
    return scored if keys else scored.drop("__all")
