"""Rebalanced long-only portfolios from lane selections, for all rebalance dates at once.

Inside one holding period the portfolio value relative to its start depends only on the targets and
prices, so periods are computed independently and chained by a running product. Trading costs couple
neighbouring periods through one number per period, which is the only sequential step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.metrics import drawdown_of_values
from panelspark.functions.scalar import change, number, symbol_key
from panelspark.functions.windows import lag
from panelspark.operators.asof import asof_join, next_listed_date
from panelspark.operators.lanes import deduplicate_selections
from panelspark.session import cut_lineage, require_columns


@dataclass(frozen=True)
class PortfolioConfig:
    starting_capital: float = 100_000.0
    selected_lanes: tuple[str, ...] = ()
    max_positions: int = 25
    sizing: str = "equal_weight"
    cost_bps: float = 0.0
    max_position_weight: float | None = None
    price_col: str = "adj_close"
    #: use returns after the rebalance date as well when estimating volatility
    full_sample_volatility: bool = False

    def __post_init__(self):
        if self.starting_capital <= 0 or self.max_positions <= 0 or self.cost_bps < 0:
            raise ValueError("capital and positions must be positive, costs non-negative")
        if self.sizing not in ("equal_weight", "inverse_volatility"):
            raise ValueError("sizing must be equal_weight or inverse_volatility")
        if self.max_position_weight is not None and not 0 < self.max_position_weight <= 1:
            raise ValueError("max_position_weight must be in (0, 1]")


def trading_days(panel: DataFrame) -> DataFrame:
    """Distinct dates: bounded by the calendar."""
    return panel.select(F.col("date").cast("date").alias("date")).distinct()


def forward_filled_prices(panel: DataFrame, price: str = "adj_close") -> DataFrame:
    """Long form of the date x symbol price matrix: every trading day from a symbol's first price on.

    Gaps are filled by expanding each row over the day numbers up to the symbol's next row, so there is
    no date x symbol product to build and prune.
    """
    numbered = trading_days(panel).select(
        F.col("date"), F.row_number().over(Window.orderBy("date")).alias("__k"))
    numbered = numbered.withColumn("__last", F.max("__k").over(Window.orderBy(F.desc("__k"))))
    rows = panel.select(symbol_key("symbol").alias("symbol"), F.col("date").cast("date").alias("date"), number(price).alias("price"))
    rows = rows.filter("price is not null").join(F.broadcast(numbered), "date")
    nxt = F.lead("__k").over(Window.partitionBy("symbol").orderBy("__k"))
    rows = rows.withColumn("__upto", F.coalesce(nxt - 1, F.col("__last"))).drop("date", "__last")
    spread = rows.withColumn("__k", F.explode(F.sequence("__k", "__upto"))).drop("__upto")
    return spread.join(F.broadcast(numbered.drop("__last")), "__k").select("date", "symbol", "price")


def normalize_selections(trades: DataFrame) -> DataFrame:
    require_columns(trades, ("as_of_date", "symbol", "lane"), "selections")
    cols = {"as_of_date": F.col("as_of_date").cast("date"), "symbol": symbol_key("symbol"), "lane": F.col("lane").cast("string")}
    if "score" in trades.columns:
        cols["score"] = number("score")
    return trades.withColumns(cols)


def align_to_trading_days(selections: DataFrame, days: DataFrame) -> DataFrame:
    """Attach the first trading day at or after each as-of date."""
    asked = selections.select(F.col("as_of_date").alias("date"))
    found = next_listed_date(asked, days.select(F.col("date").alias("as_of_date")))
    found = found.select(F.col("date").alias("as_of_date"), F.col("as_of_date").alias("rebalance_date"))
    return selections.join(F.broadcast(found), "as_of_date")


def with_capped_weights(df: DataFrame, keys, raw: str, cap: float | None, out: str = "weight") -> DataFrame:
    """Normalise ``raw`` to 1 per key with no weight above ``cap``; what cannot be placed stays cash.

    Exact water filling: rows by falling weight, the first m rows take the cap and the rest share what
    remains in proportion; m is the smallest count for which no shared weight exceeds the cap.
    """
    total = F.sum(raw).over(Window.partitionBy(*keys))
    df = df.withColumn("__w", F.try_divide(F.col(raw), total))
    if cap is None:
        return df.withColumn(out, F.col("__w")).drop("__w")
    order = Window.partitionBy(*keys).orderBy(F.desc("__w"), "symbol")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "__i": F.row_number().over(order) - 1,
        "__rest": F.lit(1.0) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
    })
    # the weight this row would get if exactly the rows above it were capped
    share = F.try_divide((F.lit(1.0) - F.col("__i") * cap) * F.col("__w"), F.col("__rest"))
    df = df.withColumn("__share", share)
    fits = F.when(F.col("__share") <= cap + 1e-12, F.col("__i"))
    df = df.withColumn("__m", F.min(fits).over(Window.partitionBy(*keys)))
    at_m = F.max(F.when(F.col("__i") == F.col("__m"), (F.lit(1.0) - F.col("__m") * cap) / F.col("__rest"))).over(Window.partitionBy(*keys))
    weight = F.when(F.col("__m").isNull() | (F.col("__i") < F.col("__m")), F.lit(cap)).otherwise(at_m * F.col("__w"))
    return df.withColumn(out, weight).drop("__w", "__i", "__rest", "__share", "__m")


def volatility_at(panel: DataFrame, targets: DataFrame, config: PortfolioConfig) -> DataFrame:
    """Deviation of the symbol's daily returns, by default only those up to the rebalance date."""
    returns = panel.select("symbol", F.col("date").cast("date").alias("date"),
                           change(config.price_col, lag(config.price_col)).alias("__r"))
    if config.full_sample_volatility:
        return targets.join(returns.groupBy("symbol").agg(F.stddev_samp("__r").alias("__vol")), "symbol", "left")
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = returns.select("symbol", "date", F.stddev_samp("__r").over(upto).alias("__vol"))
    out = asof_join(targets, running, by="symbol", left_on="rebalance_date", right_on="date", values=["__vol"])
    return out.drop("date")


def portfolio_targets(selections: DataFrame, panel: DataFrame, config: PortfolioConfig | None = None) -> DataFrame:
    """Target weights per rebalance date. ``selections`` carry a ``rebalance_date``.

    Only symbols with a price on or before the date qualify.
    """
    config = config or PortfolioConfig()
    rows = selections
    if config.selected_lanes:
        rows = rows.filter(F.col("lane").isin(list(config.selected_lanes)))
    deduped = deduplicate_selections(rows)
    prices = panel.select(symbol_key("symbol").alias("symbol"), F.col("date").cast("date").alias("__pd"),
                          number(config.price_col).alias("price"))
    prices = prices.filter("price is not null")
    priced = asof_join(deduped, prices, by="symbol", left_on="rebalance_date", right_on="__pd", values=["price"]).drop("__pd")
    priced = priced.filter("price is not null")
    order = Window.partitionBy("rebalance_date").orderBy(
        F.col("score").desc_nulls_last(), F.col("rank").asc_nulls_last(), "symbol")
    top = priced.withColumn("__pos", F.row_number().over(order)).filter(F.col("__pos") <= config.max_positions).drop("__pos")
    per_date = Window.partitionBy("rebalance_date")
    if config.sizing == "equal_weight":
        weight = F.lit(1.0) / F.count("*").over(per_date)
        if config.max_position_weight is not None:
            weight = F.least(weight, F.lit(config.max_position_weight))
        return top.withColumn("weight", weight)
    sized = volatility_at(panel, top, config).withColumn("__raw", F.try_divide(F.lit(1.0), F.col("__vol")))
    sized = sized.withColumn("__raw", F.coalesce("__raw", F.lit(0.0)))
    return with_capped_weights(sized, ["rebalance_date"], "__raw", config.max_position_weight).drop("__raw", "__vol")


def holdings(targets: DataFrame) -> DataFrame:
    return targets.select("rebalance_date", "symbol", "weight", "lane_source", "lanes_matched", "score")


def _periods(targets: DataFrame) -> DataFrame:
    """Rebalance dates with their successors: bounded by the calendar."""
    dates = targets.select("rebalance_date").distinct()
    return dates.select("rebalance_date", F.lead("rebalance_date").over(Window.orderBy("rebalance_date")).alias("next_date"))


def _paths(targets: DataFrame, panel: DataFrame, config: PortfolioConfig) -> DataFrame:
    """Held symbol prices relative to the rebalance price, on every day of the holding period.

    The closing rebalance day belongs to both periods: to the old one for valuation.
    """
    periods = _periods(targets)
    days = trading_days(panel).join(periods.withColumn("date", F.col("rebalance_date")), "date", "left")
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    inside = days.select(
        "date", F.last("rebalance_date", ignorenulls=True).over(order).alias("rebalance_date")
    ).filter("rebalance_date is not null").join(periods, "rebalance_date").select("rebalance_date", "next_date", "date")
    closing = periods.filter("next_date is not null").select("rebalance_date", "next_date", F.col("next_date").alias("date"))
    grid = inside.unionByName(closing)
    held = targets.select("rebalance_date", "symbol", "weight", F.col("price").alias("__start"))
    cells = held.join(F.broadcast(grid), "rebalance_date")
    prices = panel.select(symbol_key("symbol").alias("symbol"), F.col("date").cast("date").alias("date"), number(config.price_col).alias("__p"))
    cells = cells.join(prices, ["symbol", "date"], "left")
    path = Window.partitionBy("rebalance_date", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # on the first day the rebalance price holds, later days carry the last known price
    seen = F.when(F.col("date") == F.col("rebalance_date"), F.col("__start")).otherwise(F.col("__p"))
    cells = cells.withColumn("__now", F.last(seen, ignorenulls=True).over(path))
    return cells.withColumn("ratio", F.try_divide(F.col("__now"), F.col("__start")))


#: Rounds in which the costs of all dates settle; each one shrinks what is open by about the cost rate.
COST_ROUNDS = 60


def _trades_and_costs(targets: DataFrame, paths: DataFrame, config: PortfolioConfig) -> DataFrame:
    """Per rebalance date: its cost fraction and ``gross``, the old period's growth less the cost paid at its start.

    A date's cost depends on the cost of the date before it only through what that cost took from the old weights, so an error in
    it comes out smaller by about the cost rate. All dates are therefore computed at once from the costs of the round before,
    until no cost changes. The weight pairs of a date (at most twice ``max_positions``) stay in a row of their own; what is ordered by
    date and sent around is one number per date.
    """
    closing = paths.filter(F.col("date") == F.col("next_date")).select(
        F.col("next_date").alias("rebalance_date"), "symbol", (F.col("weight") * F.col("ratio")).alias("__old"), F.col("weight").alias("__w0"))
    pair = targets.select("rebalance_date", "symbol", "weight").join(closing, ["rebalance_date", "symbol"], "full_outer")
    new, old = F.coalesce("weight", F.lit(0.0)), F.coalesce("__old", F.lit(0.0))
    by_date = cut_lineage(pair.groupBy("rebalance_date").agg(
        F.collect_list(F.struct(new.alias("new"), old.alias("old"))).alias("__pairs"),
        (F.lit(1.0) - F.sum(F.coalesce("__w0", F.lit(0.0))) + F.sum(old)).alias("__growth"),
    ))
    rate = config.cost_bps / 10_000.0
    gross = F.col("__growth") - F.col("__before")
    moved = F.aggregate("__pairs", F.lit(0.0), lambda a, p: a + F.abs(p["new"] - F.try_divide(p["old"], F.col("gross"))))
    before = F.coalesce(F.lag("cost").over(Window.orderBy("rebalance_date")), F.lit(0.0))
    costs = by_date.select("rebalance_date", F.lit(0.0).alias("cost"))
    for _ in range(COST_ROUNDS):
        known = costs.select("rebalance_date", before.alias("__before"), F.col("cost").alias("__last"))  # one row per rebalance date
        stepped = by_date.join(F.broadcast(known), "rebalance_date").withColumn("gross", gross).withColumn("cost", moved * rate)
        costs = cut_lineage(stepped.select("rebalance_date", "gross", "cost", "__last"))
        if not costs.filter(F.abs(F.col("cost") - F.col("__last")) > 1e-15).head(1):
            break
    return costs.select("rebalance_date", "gross", "cost")


def run_portfolio(selections: DataFrame, panel: DataFrame, config: PortfolioConfig | None = None) -> dict[str, DataFrame]:
    """Daily returns, holdings and trades of the rebalanced portfolio."""
    config = config or PortfolioConfig()
    rows = normalize_selections(selections)
    if "rebalance_date" not in rows.columns:
        rows = align_to_trading_days(rows, trading_days(panel))
    # both tables are bounded by the calendar times ``max_positions``; storing them keeps the selection
    # and the price lookups from being planned and run once per result
    targets = cut_lineage(portfolio_targets(rows, panel, config))
    paths = cut_lineage(_paths(targets, panel, config))
    costs = cut_lineage(_trades_and_costs(targets, paths, config))
    # value at each rebalance: gross growth of the previous period, then its own cost
    chain = Window.orderBy("rebalance_date").rowsBetween(Window.unboundedPreceding, 0)
    # ``gross`` is measured per unit of the previous value before cost, so the product holds all costs
    values = costs.withColumn("gross_value", F.lit(config.starting_capital) * F.product("gross").over(chain))
    inside = paths.groupBy("rebalance_date", "next_date", "date").agg(
        (F.lit(1.0) - F.sum("weight") + F.sum(F.col("weight") * F.col("ratio"))).alias("__growth"))
    inside = inside.join(F.broadcast(values), "rebalance_date")
    value = F.col("gross_value") * (F.col("__growth") - F.col("cost"))
    is_start = F.col("date") == F.col("rebalance_date")
    is_close = F.coalesce(F.col("date") == F.col("next_date"), F.lit(False))
    days = inside.filter(~is_close | is_start).select(
        "date", value.alias("portfolio_value"),
        F.when(is_start, F.col("gross_value")).otherwise(value).alias("__gross"),
        F.when(is_start, F.col("gross_value") * F.col("cost")).otherwise(0.0).alias("transaction_cost"),
    )
    before = F.coalesce(F.lag("portfolio_value").over(Window.orderBy("date")), F.lit(config.starting_capital))
    daily = days.withColumn("__before", before).select(
        "date", (F.try_divide(F.col("__gross"), F.col("__before")) - 1.0).alias("gross_return"), "transaction_cost",
        (F.try_divide(F.col("portfolio_value"), F.col("__before")) - 1.0).alias("net_return"), "portfolio_value",
    )
    closing = paths.filter(F.col("date") == F.col("next_date")).select(
        F.col("next_date").alias("rebalance_date"), "symbol", (F.col("weight") * F.col("ratio")).alias("__old"))
    moved = targets.select("rebalance_date", "symbol", "weight").join(closing, ["rebalance_date", "symbol"], "full_outer").join(
        F.broadcast(values), "rebalance_date")
    old = F.coalesce(F.try_divide(F.col("__old"), F.col("gross")), F.lit(0.0))
    new = F.coalesce("weight", F.lit(0.0))
    moved = moved.withColumns({"old_weight": old, "new_weight": new, "trade_weight": F.abs(new - old)}).filter("trade_weight > 1e-12")
    traded = F.col("trade_weight") * F.col("gross_value")
    buys = F.col("new_weight") > F.col("old_weight")
    trades = moved.select(
        "rebalance_date", "symbol", "old_weight", "new_weight", "trade_weight", traded.alias("traded_value"),
        (traded * (config.cost_bps / 10_000.0)).alias("transaction_cost"),
        F.when(buys, "buy").otherwise("sell").alias("side"),
        F.when(buys, traded).otherwise(0.0).alias("buy_value"), F.when(~buys, traded).otherwise(0.0).alias("sell_value"),
    )
    return {"daily_returns": daily, "holdings": holdings(targets), "trades": trades}


def portfolio_summary(result: dict[str, DataFrame], config: PortfolioConfig | None = None) -> DataFrame:
    """One row of performance and trading metrics."""
    config = config or PortfolioConfig()
    daily, one = result["daily_returns"], F.lit(1).alias("__k")
    capital, root = config.starting_capital, math.sqrt(252)
    wealth = F.max_by("portfolio_value", "date") / capital
    total = wealth - 1.0
    periods = F.count("*") - 1
    grown = F.pow(wealth, F.try_divide(F.lit(252.0), periods))
    base = daily.agg(
        F.lit(capital).alias("starting_capital"), F.max_by("portfolio_value", "date").alias("ending_capital"),
        total.alias("total_return"),
        F.when((periods > 0) & (total > -1.0), grown - 1.0).otherwise(total).alias("annualized_return"),
        (F.stddev_pop("net_return") * root).alias("annualized_volatility"),
        (F.try_divide(F.avg("net_return"), F.stddev_pop("net_return")) * root).alias("sharpe_ratio"),
        F.sum("transaction_cost").alias("total_transaction_cost"),
    )
    turnover = result["trades"].groupBy("rebalance_date").agg(F.sum("trade_weight").alias("__t"))
    held = result["holdings"].groupBy("rebalance_date").agg(F.count("symbol").alias("__n"))
    parts = [
        drawdown_of_values(daily, "portfolio_value", ["date"]),
        turnover.agg(F.coalesce(F.avg("__t"), F.lit(0.0)).alias("average_turnover")),
        held.agg(F.coalesce(F.avg("__n"), F.lit(0.0)).alias("number_of_positions_average")),
        held.select("rebalance_date").union(turnover.select("rebalance_date")).agg(
            F.countDistinct("rebalance_date").alias("number_of_rebalances")),
    ]
    out = base.select("*", one)
    for p in parts:
        out = out.join(p.select("*", one), "__k")
    return out.drop("__k")
