"""Registered queries over the price panel: features, labels, joins by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import calendar
from panelspark.operators import asof, features, fundamentals, labels, validate
from panelspark.operators.research import research_frame
from panelspark.plans.registry import query, rounded

KEY = ["symbol", "date"]


def _pick(df, *names, digits=6, **over):
    return rounded(df.select(*KEY, *names), digits, **over)


@query("panel_prices")
def panel_prices(i):
    """The daily panel itself, checked for nulls on the way."""
    return validate.validate_prices(i.prices())


@query("panel_null_counts")
def panel_null_counts(i):
    return validate.null_counts(i.prices())


@query("panel_duplicate_keys")
def panel_duplicate_keys(i):
    """Rows of the raw table that share a key; the derived panel has none."""
    raw = i.table("lineitem").select("l_orderkey", "l_linenumber")
    return validate.duplicate_keys(raw, ("l_orderkey", "l_linenumber")).groupBy("rows").agg(F.count("*").alias("keys"))


@query("benchmark_split")
def benchmark_split(i):
    bench = i.benchmark().select("date", "adj_close").withColumn("symbol", F.lit("BENCH"))
    both = i.prices().select("symbol", "date", "adj_close").unionByName(bench)
    tradable, series = validate.split_benchmark(both, "bench")
    side = lambda df, name: df.groupBy(F.lit(name).alias("side")).agg(
        F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"))
    return side(tradable, "tradable").unionByName(side(series, "benchmark"))


@query("price_base_features")
def price_base_features(i):
    return _pick(features.base_features(i.prices()), "adj_open", "return_1d", "next_open", adj_open=None, next_open=None)


@query("price_return_features")
def price_return_features(i):
    df = features.return_features(features.base_features(i.prices()))
    w = features.RETURN_WINDOWS
    exits = {f"exit_close_{n}d": None for n in w}
    return _pick(df, *[f"{p}_{n}d" for n in w for p in ("return", "momentum", "volatility", "exit_close")], **exits)


@query("price_skip_and_ratio_features")
def price_skip_and_ratio_features(i):
    w = features.RETURN_WINDOWS
    df = features.skip_and_ratio_features(features.return_features(features.base_features(i.prices())))
    return _pick(df, *[f"return_{n}d_skip_5d" for n in w[1:]], *[f"volatility_ratio_{a}d_{b}d" for a, b in zip(w, w[1:])])


@query("price_volume_features")
def price_volume_features(i):
    df = features.volume_features(i.prices())
    w = features.VOLUME_WINDOWS
    # the mean dollar volume is compared through its logarithm, which has no half-cent rounding ties
    families = ("avg_volume", "relative_volume", "log_avg_dollar_volume")
    return _pick(df, "volume_change_5d", "dollar_volume", "log_dollar_volume",
                 *[f"{p}_{n}d" for n in w for p in families], dollar_volume=None)


@query("price_range_features")
def price_range_features(i):
    df = features.range_features(i.prices())
    names = [f"price_above_sma_{n}" for n in features.SMA_WINDOWS]
    names += [f"{p}_{n}d{s}" for n in features.RANGE_WINDOWS
              for p, s in (("distance_from", "_high"), ("drawdown", ""), ("high_low_range", ""))]
    return _pick(df, *names)


@query("price_lagged_features")
def price_lagged_features(i):
    df = features.lagged_features(features.return_features(features.base_features(i.prices())))
    return _pick(df, *[f"{p}_{n}d_lag_1" for n in (5, 10, 20) for p in ("return", "volatility")])


@query("calendar_features")
def calendar_features(i):
    df = features.calendar_features(i.prices())
    return _pick(df, "day_of_week", "month", "quarter", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
                 "days_to_month_end", "is_month_end")


@query("cross_sectional_zscores")
def cross_sectional_zscores(i):
    df = features.return_features(features.base_features(i.prices()), (5, 10, 20))
    df = features.cross_sectional_features(features.volume_features(df), (5, 10, 20))
    return _pick(df, *[f"zscore_{c}" for c in ("return_5d", "return_20d", "volatility_5d", "volatility_20d",
                                                "relative_volume_20d", "log_avg_dollar_volume_20d")])


@query("relative_strength_index")
def relative_strength_index(i):
    return _pick(features.rsi(i.prices()), "rsi_14")


@query("moving_average_convergence")
def moving_average_convergence(i):
    return _pick(features.macd(i.prices()), "macd_12_26", "macd_signal_9", "macd_histogram_12_26_9", digits=4)


@query("bollinger_bands")
def bollinger_bands(i):
    return _pick(features.bollinger(i.prices()), "bollinger_pct_b_20_2", "bollinger_width_20_2")


@query("average_true_range")
def average_true_range(i):
    return _pick(features.average_true_range(i.prices()), "atr_14", digits=4)


@query("interaction_features")
def interaction_features(i):
    df = features.volume_features(features.return_features(features.base_features(i.prices())))
    df = features.interaction_features(df)
    return _pick(df, *[c for c in df.columns if "_x_" in c])


@query("factor_proxies")
def factor_proxies(i):
    df = features.return_features(features.base_features(i.prices()))
    df = features.factor_proxies(df)
    return _pick(df, "momentum_factor", "low_vol_factor", "quality_factor")


@query("sector_relative_features")
def sector_relative_features(i):
    w = (5, 20)
    df = features.return_features(features.base_features(i.prices()), w)
    df = features.volume_features(df, (20,))
    df = features.sector_relative_features(df, i.universe(), w)
    names = [f"sector_rank_{c}" for c in ("return_5d", "return_20d", "momentum_20d", "volatility_5d", "volatility_20d",
                                         "relative_volume_20d", "log_avg_dollar_volume_20d")]
    names += [f"{p}_{n}d" for n in w for p in ("sector_return", "stock_minus_sector_return")]
    return _pick(df, "sector", *names)


@query("market_relative_features")
def market_relative_features(i):
    w = (5, 20)
    df = features.return_features(features.base_features(i.prices()), w)
    df = features.market_relative_features(df, i.benchmark(), w)
    return _pick(df, "market_return_1d", *[f"{p}_{n}d" for n in w for p in ("market_return", "stock_minus_market_return")],
                 *[f"{p}_{n}d" for n in (60, 120) for p in ("beta", "correlation_to_market")])


@query("forward_labels")
def forward_labels(i):
    df = labels.forward_labels(i.prices(), i.benchmark(), (5, 20))
    return _pick(df, *[f"fwd_{h}d_{k}" for h in (5, 20)
                       for k in ("return", "excess_return", "exec_return", "exec_excess_return")])


@query("discovery_derived_features")
def discovery_derived_features(i):
    df = features.discovery_features(i.prices())
    return _pick(df, "return_1d", "price_above_sma_20", "price_above_sma_50", "price_above_sma_200",
                 "distance_from_52w_high", "drawdown_from_52w_high", "relative_volume_5d", "volume_zscore_20d",
                 "downside_volatility_20d", "max_drawdown_60d")


@query("volatility_table")
def volatility_table(i):
    return rounded(features.volatility_table(i.prices()))


@query("sector_return_table")
def sector_return_table(i):
    return rounded(features.sector_return_table(i.prices(), i.universe(), 5, 3))


@query("research_frame")
def research_frame_query(i):
    """The flagship plan: every default feature and label, here projected to one column per family."""
    df = research_frame(i.prices(), i.universe(), benchmark=i.benchmark(), horizons=(5, 20))
    return _pick(df, "sector", "return_20d", "volatility_20d", "return_20d_skip_5d", "relative_volume_20d",
                 "price_above_sma_50", "drawdown_60d", "sector_rank_momentum_20d", "sector_rank_volatility_20d",
                 "stock_minus_sector_return_20d", "stock_minus_market_return_20d", "beta_60d", "fwd_5d_excess_return",
                 "fwd_20d_exec_return")


@query("fundamentals_asof_join")
def fundamentals_asof_join(i):
    df = fundamentals.enrich_with_fundamentals(i.prices().select(*KEY, "adj_close"), fundamentals_table(i))
    return _pick(df, "adj_close", "fundamentals_as_of_date", "market_cap", "revenue_growth", "gross_margin", "forward_pe",
                 "earnings_date", adj_close=None)


def fundamentals_table(i):
    return fundamentals.normalize_fundamentals(i.fundamentals())


@query("fundamentals_normalized")
def fundamentals_normalized(i):
    """Raw rows in vendor spelling, two arrivals per key; the later one is kept."""
    raw = i.fundamentals().withColumnRenamed("revenue_growth", "revenue_growth_yoy").withColumn(
        "symbol", F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")))
    older = raw.withColumns({"arrival": F.lit(1), "forward_pe": F.lit("n/a")})
    newer = raw.withColumns({"arrival": F.lit(2), "forward_pe": F.col("forward_pe").cast("string")})
    out = fundamentals.normalize_fundamentals(older.unionByName(newer), arrival="arrival")
    return rounded(out.select("symbol", "as_of_date", "market_cap", "revenue_growth", "eps_growth", "forward_pe",
                              "earnings_date", "source"))


@query("fundamentals_latest")
def fundamentals_latest(i):
    out = fundamentals.latest_fundamentals(fundamentals_table(i), "1999-08-15")
    return rounded(out.select("symbol", "as_of_date", "market_cap", "return_on_equity"))


@query("quality_growth_eligibility")
def quality_growth_eligibility(i):
    f = fundamentals_table(i)
    return f.select("symbol", "as_of_date", fundamentals.quality_eligible(f.columns).alias("eligible"))


def monthly_dates(i):
    from panelspark.operators.lanes import rebalance_dates

    return rebalance_dates(i.prices(), "monthly")


@query("rebalance_dates")
def rebalance_dates_query(i):
    from panelspark.operators.lanes import rebalance_dates

    p = i.prices().select("date")
    return rebalance_dates(p, "monthly").withColumn("schedule", F.lit("monthly")).unionByName(
        rebalance_dates(p, "weekly", start="1996-01-01", end="2000-12-31").withColumn("schedule", F.lit("weekly")))


@query("latest_rows_as_of")
def latest_rows_as_of(i):
    df = asof.latest_rows_at(i.prices().select(*KEY, "adj_close"), monthly_dates(i))
    return df


@query("next_available_price")
def next_available_price(i):
    """First price strictly after each order's plan date."""
    orders = i.ledger().select("order_id", "symbol", "planned_date")
    prices = i.prices().select("symbol", "date", "open")
    return asof.asof_lookup(orders, prices, by="symbol", left_on="planned_date", right_on="date", values=["open"],
                          direction="forward", strict=True)


@query("first_price_on_or_after_target")
def first_price_on_or_after_target(i):
    orders = i.ledger().select("order_id", "symbol", "target_exit_date")
    prices = i.prices().select("symbol", "date", "adj_close")
    return asof.asof_lookup(orders, prices, by="symbol", left_on="target_exit_date", right_on="date",
                          values=["adj_close"], direction="forward")


@query("aligned_rebalance_dates")
def aligned_rebalance_dates(i):
    """Calendar month starts mapped to the first trading date at or after them."""
    days = i.prices().select("date").distinct()
    starts = days.select(F.trunc("date", "month").alias("date")).distinct()
    listed = days.select(F.col("date").alias("as_of_date"))
    return asof.next_listed_date(starts, listed).select(F.col("date").alias("raw_date"),
                                                        F.col("as_of_date").alias("rebalance_date"))


@query("latest_price_per_symbol")
def latest_price_per_symbol(i):
    return asof.latest_per_key(i.prices().select(*KEY, "adj_close"))


@query("score_lookup_exact")
def score_lookup_exact(i):
    """Score on exactly the mark date, beside the latest score up to it."""
    from panelspark.operators.ledger import attach_scores

    orders = i.ledger().select("order_id", "symbol", F.col("target_exit_date").alias("date"))
    scores = i.scored().select("symbol", "date", "score").filter("score is not null")
    exact = attach_scores(orders, scores, out="exact_score")
    return attach_scores(exact, scores, out="asof_score", exact=False)


@query("business_day_arithmetic")
def business_day_arithmetic(i):
    o = i.table("orders")
    day = F.to_date("o_orderdate")
    later = F.date_add(day, (F.col("o_orderkey") % 50).cast("int"))
    return o.groupBy(day.alias("day"), (F.col("o_orderkey") % 50).cast("int").alias("step")).agg(
        F.max(calendar.business_days_between(day, later)).alias("between_days"),
        F.max(calendar.add_business_days(day, F.lit(20))).alias("plus_20"),
        F.max(calendar.subtract_business_days(day, F.lit(5))).alias("minus_5"),
        F.max(calendar.week_ending_friday(day)).alias("week_end"),
        F.max(calendar.month_key(day)).alias("month"),
    )
