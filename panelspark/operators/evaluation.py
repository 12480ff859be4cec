"""Evaluating ranked selections: long/short positions, risk controls and diagnostics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.crosssection import with_ends
from panelspark.functions.metrics import compound
from panelspark.functions.scalar import col
from panelspark.functions.windows import compounded
from panelspark.operators import folds
from panelspark.session import require_columns


@dataclass(frozen=True)
class EvaluationConfig:
    long_fraction: float = 0.1
    short_fraction: float = 0.1
    max_position_weight: float = 0.02
    transaction_cost_bps: float = 5.0
    slippage_bps: float = 5.0
    target_volatility: float | None = None
    volatility_lookback: int = 20
    max_leverage: float = 1.0
    max_drawdown_stop: float | None = None
    cooldown_days: int = 20
    initial_capital: float = 2_000.0
    allow_fractional_shares: bool = False
    min_trade_dollars: float = 1.0
    min_score: float | None = None
    rebalance_interval_days: int = 1
    max_adv_fraction: float | None = 0.01

    def __post_init__(self):
        for name in ("long_fraction", "short_fraction", "max_position_weight"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in (0, 1]")
        for name in ("transaction_cost_bps", "slippage_bps", "cooldown_days", "min_trade_dollars"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must be non-negative")
        positive = ("target_volatility", "max_leverage", "initial_capital",
                    "rebalance_interval_days", "max_adv_fraction")
        for name in positive:
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive")
        if self.volatility_lookback <= 1:
            raise ValueError("volatility_lookback must be greater than 1")
        if self.max_drawdown_stop is not None and not 0 < self.max_drawdown_stop < 1:
            raise ValueError("max_drawdown_stop must be in (0, 1)")
        if self.min_score is not None and not math.isfinite(self.min_score):
            raise ValueError("min_score must be finite")


def _wanted(rows, fraction: float):
    return F.greatest(F.lit(1), F.floor(rows * F.lit(fraction)).cast("int"))


# --- long/short -----------------------------------------------------------------------------------


def positions(
    scored: DataFrame, config: EvaluationConfig, keys=(), *, score: str = "score",
    outcome: str = "forward_return", stored: bool = False,
) -> DataFrame:
    """One row per held position: side, weight and contribution, for all dates at once.

    A symbol can be on both sides of a date with few rows. Ties are broken by symbol. ``stored`` says that the rows are stored
    already, or cost less to read twice than to store.
    """
    require_columns(scored, ("date", "symbol", score, outcome), "scored returns")
    groups = [*keys, "date"]
    rows = scored.select(*groups, "symbol", F.col(score).alias("score"), F.col(outcome).alias("outcome")).filter(
        "score is not null and outcome is not null"
    )
    longs, shorts = _wanted(F.col("__n"), config.long_fraction), _wanted(F.col("__n"), config.short_fraction)
    rows = with_ends(rows, groups, "score", shorts, longs, stored=stored)
    sides = F.array_compact(F.array(F.when(F.col("__high"), F.lit("long")), F.when(F.col("__low"), F.lit("short"))))
    held = rows.withColumn("side", F.explode(sides))
    cap = F.lit(config.max_position_weight)
    weight = F.when(F.col("side") == "long", F.least(1.0 / longs, cap)).otherwise(-F.least(1.0 / shorts, cap))
    return held.select(
        *groups, "symbol", "side", weight.alias("weight"), F.col("outcome").alias("realized_return"),
        (weight * F.col("outcome")).alias("contribution"),
    )


def daily_returns(held: DataFrame, config: EvaluationConfig, keys=()) -> DataFrame:
    """Net return per date from position rows."""
    rate = (config.transaction_cost_bps + config.slippage_bps) / 10_000.0
    exposure = F.sum(F.abs("weight"))
    return held.groupBy(*keys, "date").agg(
        F.sum("contribution").alias("gross_return"),
        (exposure * rate).alias("cost"),
        (F.sum("contribution") - exposure * rate).alias("net_return"),
        F.count_if(F.col("side") == "long").alias("long_count"),
        F.count_if(F.col("side") == "short").alias("short_count"),
        exposure.alias("gross_exposure"),
    )


def lagged_leverage(returns, config: EvaluationConfig, keys=()):
    """Target over trailing annualised volatility of the previous days, clipped; 1 while unknown."""
    if config.target_volatility is None:
        return F.lit(1.0)
    n = config.volatility_lookback
    frame = Window.partitionBy(*keys).orderBy("date").rowsBetween(-n, -1)
    r = col(returns)
    deviation = F.when(F.count(r).over(frame) == n, F.stddev_samp(r).over(frame))
    raw = F.try_divide(F.lit(config.target_volatility), deviation * math.sqrt(252))
    return F.least(F.greatest(F.coalesce(raw, F.lit(1.0)), F.lit(0.0)), F.lit(config.max_leverage))


def apply_risk_controls(daily: DataFrame, config: EvaluationConfig, keys=(), returns: str = "net_return") -> DataFrame:
    """Volatility targeting and the drawdown stop on a one-row-per-date table.

    Without a stop everything is a window expression. With one, the cooldown is folded per key.
    """
    require_columns(daily, ("date", returns), "daily returns")
    out = daily.withColumn("leverage", lagged_leverage(returns, config, keys))
    if config.max_drawdown_stop is None:
        out = out.withColumns(
            {"risk_net_return": F.col(returns) * F.col("leverage"), "risk_trading_enabled": F.lit(True)}
        )
    else:
        out = out.withColumn("__levered", F.col(returns) * F.col("leverage"))
        schema = ", ".join([*[f"`{k}` {t}" for k, t in out.dtypes], "risk_net_return double, risk_trading_enabled boolean"])
        stop, days = config.max_drawdown_stop, config.cooldown_days
        grouped = out.withColumn("__all", F.lit(1)).groupBy("__all", *keys)
        out = grouped.applyInPandas(lambda pdf: folds.risk_fold(pdf.drop(columns="__all"), stop, days), schema)
        out = out.drop("__levered")
    return out.withColumn("risk_equity", compounded("risk_net_return", ["date"], keys))


def long_short_returns(
    scored: DataFrame, config: EvaluationConfig | None = None, keys=(), *, score: str = "score",
    outcome: str = "forward_return", stored: bool = False,
) -> DataFrame:
    config = config or EvaluationConfig()
    held = positions(scored, config, keys, score=score, outcome=outcome, stored=stored)
    return apply_risk_controls(daily_returns(held, config, keys), config, keys)


def portfolio_diagnostics(
    predictions: DataFrame, config: EvaluationConfig | None = None, *, score: str = "score",
    outcome: str = "forward_return", stored: bool = False,
) -> DataFrame:
    """Daily returns per split, then equity across all splits in (split, date) order."""
    daily = long_short_returns(predictions, config, ["split_id"], score=score, outcome=outcome, stored=stored)
    order = ["split_id", "date"]
    return daily.withColumns(
        {"raw_equity": compounded("net_return", order), "risk_equity_full": compounded("risk_net_return", order)}
    )


def monthly_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        compound("net_return").alias("raw_return"), compound("risk_net_return").alias("risk_return"),
        F.count_if("risk_trading_enabled").alias("trading_days"),
    )


def symbol_contributions(held: DataFrame) -> DataFrame:
    return held.groupBy("symbol").agg(
        F.count_if(F.col("side") == "long").alias("long_days"),
        F.count_if(F.col("side") == "short").alias("short_days"),
        F.sum("contribution").alias("gross_contribution"),
        F.avg("contribution").alias("avg_daily_contribution"),
        F.avg(F.abs("weight")).alias("avg_abs_weight"),
    )
