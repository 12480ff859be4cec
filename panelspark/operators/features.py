"""Leakage-safe panel features as window expressions.

Expressions over one symbol are grouped so that Spark shares a single exchange and sort on
(symbol, date); cross-sections come after, on (date) and (date, sector).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import calendar
from panelspark.functions.crosssection import WHOLE, with_group_stats, with_percent_ranks
from panelspark.functions.scalar import change, ratio
from panelspark.functions.rolling import Roll, with_rolling
from panelspark.functions.windows import lag, lead, rolling_mean, rolling_std, with_ewm, with_ewm_blocks
from panelspark.session import require_columns

RETURN_WINDOWS = (5, 10, 20, 40, 60, 120)
SMA_WINDOWS = (10, 20, 50, 200)
RANGE_WINDOWS = (10, 20, 60, 120)
VOLUME_WINDOWS = (10, 20, 40, 120)
BETA_WINDOWS = (60, 120)


def base_features(df: DataFrame, price: str = "adj_close") -> DataFrame:
    require_columns(df, ("date", "symbol", "open", "close", price), "prices")
    df = df.withColumn("adj_open", F.col("open") * ratio(price, "close"))
    return df.withColumns({"return_1d": change(price, lag(price)), "next_open": lead("adj_open")})


def return_features(df: DataFrame, windows=RETURN_WINDOWS, price: str = "adj_close") -> DataFrame:
    """Trailing returns, exit prices and volatilities; needs ``return_1d``."""
    cols = {}
    for w in windows:
        cols[f"return_{w}d"] = change(price, lag(price, w))
        cols[f"exit_close_{w}d"] = lead(price, w)
        cols[f"momentum_{w}d"] = cols[f"return_{w}d"]
    df = df.withColumns(cols)
    return with_rolling(df, {f"volatility_{w}d": Roll("std", "return_1d", w) for w in windows})


def skip_and_ratio_features(df: DataFrame, windows=RETURN_WINDOWS, price: str = "adj_close") -> DataFrame:
    cols = {
        f"return_{w}d_skip_5d": change(lag(price, 5), lag(price, w + 5)) for w in windows[1:]
    }
    for short, long in zip(windows, windows[1:]):
        cols[f"volatility_ratio_{short}d_{long}d"] = ratio(f"volatility_{short}d", f"volatility_{long}d")
    return df.withColumns(cols)


def volume_features(
    df: DataFrame, windows=VOLUME_WINDOWS, price: str = "adj_close", volume: str = "volume"
) -> DataFrame:
    df = df.withColumns(
        {"volume_change_5d": change(volume, lag(volume, 5)), "dollar_volume": F.col(price) * F.col(volume)}
    )
    means = {f"avg_volume_{w}d": Roll("mean", volume, w, dense=True) for w in windows}
    means |= {f"avg_dollar_volume_{w}d": Roll("mean", "dollar_volume", w, dense=True) for w in windows}
    df = with_rolling(df.withColumn("log_dollar_volume", F.log1p("dollar_volume")), means)
    cols = {}
    for w in windows:
        cols[f"relative_volume_{w}d"] = F.try_divide(F.col(volume), F.col(f"avg_volume_{w}d"))
        cols[f"log_avg_dollar_volume_{w}d"] = F.log1p(f"avg_dollar_volume_{w}d")
    return df.withColumns(cols)


def range_features(
    df: DataFrame, sma_windows=SMA_WINDOWS, range_windows=RANGE_WINDOWS, price: str = "adj_close"
) -> DataFrame:
    rolls = {f"__sma_{w}": Roll("mean", price, w, dense=True) for w in sma_windows}
    for w in range_windows:
        rolls |= {f"__high_{w}": Roll("max", price, w, dense=True), f"__low_{w}": Roll("min", price, w, dense=True)}
    df = with_rolling(df, rolls)
    cols = {f"price_above_sma_{w}": change(price, f"__sma_{w}") for w in sma_windows}
    for w in range_windows:
        cols[f"distance_from_{w}d_high"] = change(price, f"__high_{w}")
        cols[f"drawdown_{w}d"] = change(price, f"__high_{w}")
        cols[f"high_low_range_{w}d"] = change(f"__high_{w}", f"__low_{w}")
    return df.withColumns(cols).drop(*rolls)


def lagged_features(df: DataFrame, windows=RETURN_WINDOWS) -> DataFrame:
    cols = {}
    for w in windows[:3]:
        cols[f"return_{w}d_lag_1"] = lag(f"return_{w}d")
        cols[f"volatility_{w}d_lag_1"] = lag(f"volatility_{w}d")
    return df.withColumns(cols)


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date).cast("date")
    weekday, month = F.weekday(d), F.month(d)
    day_angle, month_angle = weekday * (2 * math.pi / 7), (month - 1) * (2 * math.pi / 12)
    left = calendar.days_to_month_end(d)
    return df.withColumns(
        {
            "day_of_week": weekday,
            "month": month,
            "quarter": F.quarter(d),
            "day_of_week_sin": F.sin(day_angle),
            "day_of_week_cos": F.cos(day_angle),
            "month_sin": F.sin(month_angle),
            "month_cos": F.cos(month_angle),
            "days_to_month_end": left,
            "is_month_end": (left == 0).cast("int"),
        }
    )


def zscore_columns(windows=RETURN_WINDOWS) -> list[str]:
    return [
        *[f"return_{w}d" for w in (windows[0], windows[2])],
        *[f"volatility_{w}d" for w in (windows[0], windows[2], windows[-1])],
        "relative_volume_20d",
        "log_avg_dollar_volume_20d",
    ]


def cross_sectional_features(df: DataFrame, windows=RETURN_WINDOWS) -> DataFrame:
    """Per-date z-scores across the universe."""
    names = [c for c in zscore_columns(windows) if c in df.columns]
    stats = {}
    for c in names:
        stats[f"__m_{c}"], stats[f"__s_{c}"] = F.avg(c), F.stddev_samp(c)
    df = with_group_stats(df, ["date"], stats)
    cols = {
        f"zscore_{c}": F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in names
    }
    return df.withColumns(cols).drop(*stats)


def rsi(df: DataFrame, price: str = "adj_close", w: int = 14) -> DataFrame:
    df = df.withColumn("__delta", F.col(price) - lag(price))
    gain = F.when(F.col("__delta").isNotNull(), F.greatest("__delta", F.lit(0.0)))
    loss = F.when(F.col("__delta").isNotNull(), F.greatest(-F.col("__delta"), F.lit(0.0)))
    strength = F.try_divide(rolling_mean(gain, w), rolling_mean(loss, w))
    return df.withColumn(f"rsi_{w}", 100.0 - F.try_divide(F.lit(100.0), strength + 1.0)).drop("__delta")


def macd(df: DataFrame, price: str = "adj_close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    line, smooth, gap = f"macd_{fast}_{slow}", f"macd_signal_{signal}", f"macd_histogram_{fast}_{slow}_{signal}"
    df = with_ewm(with_ewm_blocks(df), {"__fast": (price, fast), "__slow": (price, slow)})
    df = df.withColumn(line, F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    df = with_ewm(df, {smooth: (line, signal)}).drop("__b", "__r")
    return df.withColumn(gap, F.col(line) - F.col(smooth))


def bollinger(df: DataFrame, price: str = "adj_close", w: int = 20) -> DataFrame:
    middle, deviation = rolling_mean(price, w, dense=True), rolling_std(price, w, dense=True)
    width = deviation * 4.0
    return df.withColumns(
        {
            f"bollinger_pct_b_{w}_2": F.try_divide(F.col(price) - (middle - deviation * 2.0), width),
            f"bollinger_width_{w}_2": F.try_divide(width, middle),
        }
    )


def average_true_range(df: DataFrame, price: str = "adj_close", w: int = 14) -> DataFrame:
    df = df.withColumn("__prev", lag(price))
    span = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__prev")), F.abs(F.col("low") - F.col("__prev"))
    )
    df = df.withColumn("__span", span)
    return df.withColumn(f"atr_{w}", rolling_mean("__span", w)).drop("__prev", "__span")


def technical_indicators(df: DataFrame, price: str = "adj_close") -> DataFrame:
    return average_true_range(bollinger(macd(rsi(df, price), price), price), price)


def interaction_features(df: DataFrame, windows=RETURN_WINDOWS, volume_windows=VOLUME_WINDOWS) -> DataFrame:
    pairs = [
        (f"return_{windows[1]}d", f"volatility_{windows[1]}d"),
        (f"return_{windows[0]}d", f"volatility_{windows[0]}d"),
        (f"volatility_{windows[1]}d", f"relative_volume_{volume_windows[0]}d"),
        (f"return_{windows[2]}d", "volume_change_5d"),
    ]
    return df.withColumns(
        {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if a in df.columns and b in df.columns}
    )


def factor_proxies(df: DataFrame, windows=RETURN_WINDOWS) -> DataFrame:
    df = with_rolling(df, {"__deviation": Roll("std", "return_1d", 60)})
    cols = {"quality_factor": -F.col("__deviation")}
    if len(windows) >= 6:
        cols["momentum_factor"] = F.col(f"return_{windows[-1]}d") - F.col(f"return_{windows[1]}d")
    base = f"volatility_{windows[2] if len(windows) > 2 else windows[-1]}d"
    df = with_percent_ranks(df.withColumns(cols).drop("__deviation"), ["date"], {"__low": (base, True)}, whole=WHOLE)
    return df.withColumn("low_vol_factor", 1.0 - F.col("__low")).drop("__low")


def price_features(
    df: DataFrame,
    *,
    price: str = "adj_close",
    windows=RETURN_WINDOWS,
    sma_windows=SMA_WINDOWS,
    range_windows=RANGE_WINDOWS,
    volume_windows=VOLUME_WINDOWS,
    lagged: bool = False,
    calendar_columns: bool = False,
    cross_sectional: bool = False,
    technical: bool = False,
    interactions: bool = False,
    factors: bool = False,
) -> DataFrame:
    """All per-symbol features, then the optional groups."""
    df = base_features(df, price)
    df = return_features(df, windows, price)
    df = skip_and_ratio_features(df, windows, price)
    df = volume_features(df, volume_windows, price)
    df = range_features(df, sma_windows, range_windows, price)
    if lagged:
        df = lagged_features(df, windows)
    if technical:
        df = technical_indicators(df, price)
    if calendar_columns:
        df = calendar_features(df)
    if interactions:
        df = interaction_features(df, windows, volume_windows)
    if cross_sectional:
        df = cross_sectional_features(df, windows)
    if factors:
        df = factor_proxies(df, windows)
    return df


def attach_sector(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Left join of the sector; the planner broadcasts the dimension only if its size allows."""
    require_columns(universe, ("symbol", "sector"), "universe")
    dim = universe.select(F.upper("symbol").alias("symbol"), "sector").dropDuplicates(["symbol"])
    return df.drop("sector").join(dim, "symbol", "left")


def sector_relative_features(
    df: DataFrame, universe: DataFrame | None = None, windows=RETURN_WINDOWS, within: DataFrame | None = None, only: str | None = None,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Sector ranks, sector means and distances to them; a null sector is a group of its own.

    ``within`` may name a panel with at least the frame's rows, whose sectors are cheaper to count. ``only`` names a boolean column of
    the rows to return; all rows are ranked. With ``lines``, dates that have few of them lie in one task each, with all their sectors.
    """
    if universe is not None:
        df = attach_sector(df, universe)
        within = None if within is None else attach_sector(within.select("symbol", "date"), universe)
    keys = ["date", "sector"]
    families = ("return", "volatility", "relative_volume", "log_avg_dollar_volume")
    ranked = [f"{f}_{w}d" for w in windows for f in families if f"{f}_{w}d" in df.columns]
    have = [w for w in windows if f"return_{w}d" in df.columns]
    means = {f"sector_return_{w}d": F.avg(f"return_{w}d") for w in have}
    df = with_percent_ranks(df, keys, {f"sector_rank_{c}": (c, True) for c in ranked}, stats=means, whole=WHOLE, within=within, only=only, deal=None if lines is None else (["date"], lines))
    # momentum is the same value as the return, so its rank is too
    df = df.withColumns(
        {f"sector_rank_momentum_{w}d": F.col(f"sector_rank_return_{w}d") for w in have
         if f"momentum_{w}d" in df.columns}
    )
    return df.withColumns(
        {
            f"stock_minus_sector_return_{w}d": F.col(f"return_{w}d") - F.col(f"sector_return_{w}d")
            for w in have
        }
    )


def market_returns(benchmark: DataFrame, windows=RETURN_WINDOWS, price: str = "adj_close") -> DataFrame:
    """One row per date: the benchmark's trailing returns (bounded by the calendar)."""
    order = Window.orderBy("date")
    series = benchmark.select("date", F.col(price).alias("__p"))
    cols = {"market_return_1d": change("__p", F.lag("__p", 1).over(order))}
    cols |= {f"market_return_{w}d": change("__p", F.lag("__p", w).over(order)) for w in windows}
    return series.withColumns(cols).drop("__p")


def market_relative_features(
    df: DataFrame, benchmark: DataFrame, windows=RETURN_WINDOWS, beta_windows=BETA_WINDOWS,
    price: str = "adj_close",
) -> DataFrame:
    """Market returns, excess over the market, rolling beta and correlation.

    The broadcast side has one row per calendar date, so its size does not grow with the universe.
    """
    df = df.join(F.broadcast(market_returns(benchmark, windows, price)), "date", "left")
    cols = {
        f"stock_minus_market_return_{w}d": F.col(f"return_{w}d") - F.col(f"market_return_{w}d")
        for w in windows if f"return_{w}d" in df.columns
    }
    rolls = {}
    for w in beta_windows:
        rolls |= {f"beta_{w}d": Roll("beta", "return_1d", w, "market_return_1d"), f"correlation_to_market_{w}d": Roll("corr", "return_1d", w, "market_return_1d")}
    return with_rolling(df.withColumns(cols), rolls)


def discovery_features(df: DataFrame, price: str = "adj_close") -> DataFrame:
    """Derived columns for the discovery funnel, each only where the frame lacks it."""
    if price not in df.columns:
        return df
    if "return_1d" not in df.columns:
        df = df.withColumn("return_1d", change(price, lag(price)))
    have = set(df.columns)
    rolls = {f"__mean_{w}": Roll("mean", price, w, dense=True) for w in (20, 50, 200) if f"price_above_sma_{w}" not in have}
    if not {"distance_from_52w_high", "drawdown_from_52w_high"} <= have:
        rolls["__high_252"] = Roll("max", price, 252, dense=True)
    if "max_drawdown_60d" not in have and "drawdown_60d" not in have:
        rolls["__high_60"] = Roll("max", price, 60, dense=True)
    if "volume" in have:
        rolls |= {"__volume_5": Roll("mean", "volume", 5, dense=True), "__volume_20": Roll("mean", "volume", 20), "__deviation_20": Roll("std", "volume", 20)}
    df = df.withColumn("__loss", F.when(F.col("return_1d") < 0, F.col("return_1d")))
    rolls["__downside"] = Roll("std", "__loss", 20)
    df = with_rolling(df, rolls)
    cols = {f"price_above_sma_{w}": change(price, f"__mean_{w}") for w in (20, 50, 200) if f"__mean_{w}" in rolls}
    if "__high_252" in rolls:
        cols["distance_from_52w_high"] = change(price, "__high_252")
        cols["drawdown_from_52w_high"] = F.col("distance_from_52w_high") if "distance_from_52w_high" in have else cols["distance_from_52w_high"]
    if "volume" in have:
        cols["relative_volume_5d"] = F.try_divide(F.col("volume"), F.col("__volume_5"))
        cols["volume_zscore_20d"] = F.try_divide(F.col("volume") - F.col("__volume_20"), F.col("__deviation_20"))
    cols["downside_volatility_20d"] = F.col("__downside")
    if "max_drawdown_60d" not in have:
        cols["max_drawdown_60d"] = F.col("drawdown_60d") if "drawdown_60d" in have else change(price, "__high_60")
    return df.withColumns({k: v for k, v in cols.items() if k not in have}).drop("__loss", *rolls)


def recent_rows(df: DataFrame, last, rows: int, before=None, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Each symbol's last ``rows`` rows at or before the day ``last``: all that trailing features of that day look at.

    ``before`` may add columns while all of a symbol's rows are there, numbered by ``__back`` from 1 at the last one.
    """
    back = F.row_number().over(Window.partitionBy(symbol).orderBy(F.desc(date)))
    known = df.filter(F.col(date).cast("date") <= F.lit(str(last)).cast("date")).withColumn("__back", back)
    known = known if before is None else before(known)
    return known.filter(F.col("__back") <= rows).drop("__back")


def long_features(known: DataFrame, price: str = "adj_close", symbol: str = "symbol") -> DataFrame:
    """The features of a symbol's last row that look back over 200 rows and more, as one aggregate of the symbol instead of frames.

    Only the last row's values are meant; ``__back`` numbers the rows from it.
    """
    whole = Window.partitionBy(symbol)

    def over(w, stat):
        x = F.when(F.col("__back") <= w, F.col(price))
        return F.when(F.count(x).over(whole) == w, stat(x).over(whole))

    known = known.withColumns({"__mean_200": over(200, F.avg), "__high_252": over(252, F.max)})
    high = change(price, "__high_252")
    cols = {"price_above_sma_200": change(price, "__mean_200"), "distance_from_52w_high": high, "drawdown_from_52w_high": high}
    return known.withColumns(cols).drop("__mean_200", "__high_252")


def volatility_table(prices: DataFrame, lookback: int = 20) -> DataFrame:
    """Rolling deviation of daily returns per (symbol, date), not annualised; nulls dropped."""
    df = prices.select("symbol", "date", change("adj_close", lag("adj_close")).alias("__r"))
    df = with_rolling(df, {"volatility": Roll("std", "__r", lookback)})
    return df.select("symbol", "date", "volatility").filter("volatility is not null")


def sector_return_table(
    prices: DataFrame, universe: DataFrame, lookback: int = 5, min_records: int = 3
) -> DataFrame:
    """Rolling mean of the daily sector return, over dates with enough members."""
    dim = universe.select(F.upper("symbol").alias("symbol"), "sector")
    df = prices.select("symbol", "date", change("adj_close", lag("adj_close")).alias("__r"))
    # the panel key is unique, so counting rows counts distinct symbols without a second shuffle
    daily = (
        df.join(dim, "symbol").groupBy("date", "sector")
        .agg(F.count("*").alias("__n"), F.avg("__r").alias("__r")).filter(F.col("__n") >= min_records)
    )
    frame = Window.partitionBy("sector").orderBy("date").rowsBetween(-(lookback - 1), 0)
    full = F.when(F.count("__r").over(frame) == lookback, F.avg("__r").over(frame))
    return daily.select("sector", "date", full.alias("sector_return")).filter("sector_return is not null")
