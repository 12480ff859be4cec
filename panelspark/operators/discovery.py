"""Discovery funnel: filter, score and rank candidates, for one date or for all dates at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.crosssection import WHOLE, with_percent_ranks, with_row_index
from panelspark.functions.scalar import fixed, number, percent, ratio, symbol_key, texts
from panelspark.operators import features, validate
from panelspark.operators.fundamentals import quality_eligible
from panelspark.session import cut_lineage

# Lane names, their score columns and the component weights of each score. A negative
# weight marks a component where lower is better.
LANES = {
    "momentum_breakouts": "momentum_score",
    "sector_leaders": "sector_strength_score",
    "volume_anomalies": "attention_score",
    "quality_growth": "quality_score",
    "value_recoveries": "value_recovery_score",
}
SCORES = {
    "momentum_score": {
        "sector_rank_return_20d": 0.25, "sector_rank_momentum_20d": 0.20, "return_60d": 0.20,
        "stock_minus_sector_return_20d": 0.15, "stock_minus_market_return_20d": 0.10,
        "price_above_sma_50": 0.05, "distance_from_52w_high": 0.05,
    },
    "sector_strength_score": {
        "sector_return_20d": 0.30, "sector_return_60d": 0.25, "sector_rank_return_60d": 0.20,
        "stock_minus_sector_return_20d": 0.15, "stock_minus_sector_return_60d": 0.10,
    },
    "attention_score": {
        "relative_volume_20d": 0.35, "relative_volume_5d": 0.20, "volume_zscore_20d": 0.20,
        "volume_change_5d": 0.15, "abs_return_1d": 0.10,
    },
    "quality_score": {
        "revenue_growth": 0.20, "eps_growth": 0.18, "gross_margin": 0.10, "operating_margin": 0.10,
        "return_on_equity": 0.16, "free_cash_flow_yield": 0.10, "debt_to_equity": -0.10,
        "forward_pe": -0.03, "price_to_sales": -0.03,
    },
    "value_recovery_score": {
        "drawdown_60d": -0.20, "return_5d": 0.15, "price_above_sma_20": 0.10, "price_above_sma_50": 0.10,
        "relative_volume_20d": 0.10, "earnings_yield": 0.15, "free_cash_flow_yield": 0.10, "forward_pe": -0.10,
    },
    "catalyst_score": {
        "earnings_window_score": 0.25, "earnings_surprise_last_qtr": 0.20, "analyst_revision_30d": 0.20,
        "analyst_upgrade_count_30d": 0.15, "news_sentiment_7d": 0.10, "news_count_7d": 0.10,
    },
}
COMPOSITE = {
    "momentum_score": 0.30, "quality_score": 0.20, "value_recovery_score": 0.20, "attention_score": 0.15,
    "sector_strength_score": 0.10, "catalyst_score": 0.05,
}
METADATA = ("name", "category", "sector", "industry", "country", "exchange", "security_type", "market_cap")


@dataclass(frozen=True)
class DiscoveryConfig:
    top_n: int = 25
    price_col: str = "adj_close"
    min_price: float = 5.0
    min_avg_dollar_volume_20d: float = 5_000_000.0
    min_market_cap: float | None = 300_000_000.0
    earnings_blackout_days: int = 1
    max_volatility_20d: float | None = None
    excluded_categories: tuple[str, ...] = ("benchmark", "etf")
    excluded_security_types: tuple[str, ...] = ("ETF", "Fund")
    score_weights: dict = field(default_factory=lambda: dict(COMPOSITE))

    def __post_init__(self):
        if self.top_n <= 0:
            raise ValueError("top_n must be positive")
        for name in ("min_price", "min_avg_dollar_volume_20d", "min_market_cap"):
            value = getattr(self, name)
            if value is not None and value < 0:
                raise ValueError(f"{name} must be non-negative")


def attach_metadata(df: DataFrame, universe: DataFrame | None) -> DataFrame:
    """Left join of the dimension columns the frame does not have yet."""
    if universe is None:
        return df
    wanted = [c for c in METADATA if c in universe.columns and c not in df.columns]
    if not wanted:
        return df
    dim = universe.select(symbol_key("symbol").alias("symbol"), *wanted).dropDuplicates(["symbol"])
    return df.join(dim, "symbol", "left")


def exclusion_reasons(columns, config: DiscoveryConfig) -> Column:
    """Ordered reasons as an array; reads a boolean ``watched`` column if the frame has one."""
    have = set(columns)

    def text(name):
        return F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))) if name in have else F.lit("")

    def value(name, other=None):
        name = name if name in have else other
        return number(name) if name in have else F.lit(None).cast("double")

    category, kind = text("category"), text("security_type")
    price = value(config.price_col, "close")
    volume, days, volatility = value("avg_dollar_volume_20d"), value("days_to_earnings"), value("volatility_20d")
    cases = [
        F.when(F.col("watched"), "already_in_watchlist") if "watched" in have else F.lit(None).cast("string"),
        F.when(category.isin([c.lower() for c in config.excluded_categories]) & (category != ""),
               F.concat(F.lit("excluded_category:"), category)),
        F.when(kind.isin([c.lower() for c in config.excluded_security_types]) & (kind != ""),
               F.concat(F.lit("excluded_security_type:"), kind)),
        F.when(price.isNull(), "missing_price").when(price < config.min_price, "price_below_minimum"),
        F.when(volume.isNull(), "missing_avg_dollar_volume_20d").when(
            volume < config.min_avg_dollar_volume_20d, "avg_dollar_volume_20d_below_minimum"),
    ]
    if config.min_market_cap is not None and "market_cap" in have:
        cap = value("market_cap")
        cases.append(F.when(cap.isNull(), "missing_market_cap").when(
            cap < config.min_market_cap, "market_cap_below_minimum"))
    if config.earnings_blackout_days >= 0:
        cases.append(F.when(days.between(0, config.earnings_blackout_days), "earnings_blackout"))
    if config.max_volatility_20d is not None:
        cases.append(F.when(volatility > config.max_volatility_20d, "extreme_volatility"))
    return F.array_compact(F.array(*cases))


def with_reasons(df: DataFrame, config: DiscoveryConfig, watchlist: DataFrame | None = None) -> DataFrame:
    """``df`` with the array ``__reasons`` of what excludes a row, empty for candidates. It depends on the row alone."""
    if config.min_market_cap is not None and "market_cap" not in df.columns:
        raise ValueError("market_cap is required when min_market_cap filtering is enabled")
    if watchlist is not None:
        marked = watchlist.select("symbol", F.lit(True).alias("__watched")).distinct()
        df = df.join(marked, "symbol", "left").withColumn("watched", F.coalesce("__watched", F.lit(False))).drop("__watched")
    return df.withColumn("__reasons", exclusion_reasons(df.columns, config))


def filter_candidates(
    snapshot: DataFrame, config: DiscoveryConfig, watchlist: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split a snapshot into candidates and exclusions with their joined reasons, made here unless the snapshot has them."""
    df = snapshot if "__reasons" in snapshot.columns else with_reasons(snapshot, config, watchlist)
    kept = df.filter(F.size("__reasons") == 0).drop("__reasons", "watched")
    names = [c for c in ("as_of_date", "date", "symbol") if c in df.columns]
    blank = [validate.optional(df, c, F.lit("")).alias(c) for c in ("name", "sector", "industry")]
    out = df.filter(F.size("__reasons") > 0).select(*names, *blank, F.array_join("__reasons", "; ").alias("exclusion_reasons"))
    return kept, out


def score_helpers(df: DataFrame) -> DataFrame:
    have, cols = set(df.columns), {}
    for alias, name in (("revenue_growth_yoy", "revenue_growth"), ("eps_growth_yoy", "eps_growth")):
        if alias in have and name not in have:
            cols[name] = F.col(alias)
    if {"free_cash_flow", "market_cap"} <= have and "free_cash_flow_yield" not in have:
        cap = number("market_cap")
        cols["free_cash_flow_yield"] = ratio(number("free_cash_flow"), F.when(cap > 0, cap))
    if "return_1d" in have:
        cols["abs_return_1d"] = F.abs(number("return_1d"))
    if "forward_pe" in have and "earnings_yield" not in have:
        pe = number("forward_pe")
        cols["earnings_yield"] = ratio(F.lit(1.0), F.when(pe > 0, pe))
    if "days_to_earnings" in have and "earnings_window_score" not in have:
        days = number("days_to_earnings")
        cols["earnings_window_score"] = F.when(days.between(2, 30), (31.0 - days) / 29.0)
    return df.withColumns(cols) if cols else df


def score_candidates(
    candidates: DataFrame, config: DiscoveryConfig | None = None, keys=("date",), within: DataFrame | None = None, dealt: bool = False
) -> DataFrame:
    """Lane scores and the composite inside each key group; ``within`` is the frame that the candidates were taken from.

    ``dealt`` says that rows of a group lie together already.

    A component is its average-tie percent rank among the group's candidates, 0.5 if the group has one
    distinct value. A score is the weighted mean of the components a row has, times 100.
    """
    config = config or DiscoveryConfig()
    keys = list(keys)
    df = score_helpers(candidates)
    have = set(df.columns)
    used = list(dict.fromkeys(
        (c, w > 0) for parts in SCORES.values() for c, w in parts.items() if c in have
    ))
    ranks, clean = {}, {}
    for c, higher in used:
        clean[f"__v_{c}"] = number(c)
        ranks[f"__p_{c}_{int(higher)}"] = (f"__v_{c}", higher)
    df = df.withColumns(clean)
    df = with_percent_ranks(df, keys, ranks, flat_value=0.5, whole=WHOLE, within=within, packed=True, dealt=dealt)
    eligible = quality_eligible([c for c in df.columns if not c.startswith("__")])
    cols = {}
    for score, parts in SCORES.items():
        weighted, weight, count = F.lit(0.0), F.lit(0.0), F.lit(0)
        for c, w in parts.items():
            if c not in have:
                continue
            p = F.col(f"__p_{c}_{int(w > 0)}")
            weighted = weighted + F.coalesce(p, F.lit(0.0)) * abs(w)
            weight = weight + F.when(p.isNotNull(), abs(w)).otherwise(0.0)
            count = count + p.isNotNull().cast("int")
        value = F.when(weight > 0, F.try_divide(weighted, weight)).otherwise(0.5) * 100.0
        if score == "quality_score":
            value = F.when(eligible, value).otherwise(50.0)
            count = F.when(eligible, count).otherwise(0)
            cols["quality_score_eligible"] = eligible
        cols[score], cols[f"{score}_inputs"] = value, count
    df = df.withColumns(cols)
    total, weights = F.lit(0.0), 0.0
    for score, w in config.score_weights.items():
        if score in df.columns:
            total, weights = total + F.col(score) * w, weights + w
    df = df.withColumn("discovery_score", total / weights if weights else F.lit(50.0))
    return df.drop(*clean, *ranks)


def explanation(columns) -> Column:
    """Up to five reasons why a scored row stands out."""
    have = set(columns)

    def v(name):
        return number(name) if name in have else F.lit(None).cast("double")

    good = F.col("quality_score_eligible") if "quality_score_eligible" in have else F.lit(False)
    alpha, volume = v("stock_minus_sector_return_20d"), v("relative_volume_20d")
    text = texts(
        F.when(v("momentum_score") >= 80, "strong cross-sectional momentum score"),
        F.when(v("sector_strength_score") >= 80, "sector-relative strength is ranking well"),
        F.when(v("attention_score") >= 80, "volume or price attention signal is elevated"),
        F.when((v("quality_score") >= 80) & good, "quality and growth inputs rank well"),
        F.when(v("value_recovery_score") >= 80, "value or recovery setup ranks well"),
        F.when(alpha > 0, F.concat(F.lit("20-day return is "), percent(alpha), F.lit(" above sector average"))),
        F.when(volume >= 1.5, F.concat(F.lit("volume is "), fixed(volume, 1), F.lit("x its 20-day average"))),
        F.when(v("price_above_sma_50") > 0, "price is above its 50-day moving average"),
        F.when(v("distance_from_52w_high") >= -0.05, "price is within 5% of its 52-week high"),
        limit=5,
    )
    return F.when(text == "", "ranked well enough across available discovery inputs").otherwise(text)


def risk_flags(columns, config: DiscoveryConfig | None = None) -> Column:
    config = config or DiscoveryConfig()
    have = set(columns)

    def v(name):
        return number(name) if name in have else F.lit(None).cast("double")

    days, volatility, volume = v("days_to_earnings"), v("volatility_20d"), v("avg_dollar_volume_20d")
    near = volume < config.min_avg_dollar_volume_20d * 2 if config.min_avg_dollar_volume_20d > 0 else F.lit(False)
    return texts(
        F.when(days.between(0, 7), F.concat(F.lit("earnings in "), days.cast("int").cast("string"), F.lit(" days"))),
        F.when(volatility >= 0.05, F.concat(F.lit("20-day daily volatility is "), percent(volatility))),
        F.when(near, "liquidity is close to the discovery minimum"),
        F.when(v("beta_60d") >= 2.0, F.concat(F.lit("beta is elevated at "), fixed(v("beta_60d"), 1))),
        F.when(v("price_above_sma_200") < 0, "price is below its 200-day moving average"),
        F.when(v("forward_pe") >= 50, F.concat(F.lit("forward P/E is high at "), fixed(v("forward_pe"), 1))),
    )


def watchlists(scored: DataFrame, config: DiscoveryConfig | None = None, keys=("date",)) -> DataFrame:
    """Top rows of every lane in long form: ``lane``, ``lane_score``, ``rank`` and the source columns.

    The limit is per (key, lane), so each task keeps at most ``top_n`` rows per group before the shuffle.
    """
    config = config or DiscoveryConfig()
    have = set(scored.columns)
    lanes = []
    for lane, score in LANES.items():
        if score not in have:
            continue
        ok = F.lit(True)
        if lane == "quality_growth" and "quality_score_eligible" in have:
            ok = F.col("quality_score_eligible")
        elif f"{score}_inputs" in have:
            ok = F.col(f"{score}_inputs") > 0
        lanes.append(F.when(ok, F.struct(F.lit(lane).alias("lane"), F.col(score).alias("lane_score"))))
    long = scored.withColumn("__lane", F.explode(F.array_compact(F.array(*lanes))))
    long = long.withColumns({"lane": F.col("__lane.lane"), "lane_score": F.col("__lane.lane_score")}).drop("__lane")
    order = Window.partitionBy(*keys, "lane").orderBy(
        # scores that differ only by floating-point noise are ties
        F.round("lane_score", 9).desc_nulls_last(), F.round("discovery_score", 9).desc_nulls_last(),
        F.round("avg_dollar_volume_20d", 4).desc_nulls_last(), "symbol",
    )
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.top_n)


def run_discovery(
    frame: DataFrame, *, universe: DataFrame | None = None, as_of_date=None, watchlist: DataFrame | None = None,
    config: DiscoveryConfig | None = None, within: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The funnel for one as-of date: candidates, exclusions and watchlists.

    ``within`` may name a frame with at least the frame's rows, whose dates are cheaper to count.
    """
    config = config or DiscoveryConfig()
    df = attach_metadata(frame.withColumn("symbol", symbol_key("symbol")), universe)
    df = features.discovery_features(df, config.price_col)
    if as_of_date is not None:
        # a literal date passes through windows partitioned by date, so only its cross-section is computed
        snapshot = df.filter(F.col("date").cast("date") == F.lit(str(as_of_date)).cast("date"))
    else:
        latest = frame.agg(F.max(F.col("date").cast("date")).alias("as_of_date"))
        snapshot = df.join(F.broadcast(latest), df["date"].cast("date") == F.col("as_of_date"), "left_semi")
    if within is not None and as_of_date is not None:
        within = within.filter(F.col("date").cast("date") == F.lit(str(as_of_date)).cast("date"))
    kept, excluded = filter_candidates(snapshot, config, watchlist)
    scored = score_candidates(kept, config, ["date"], snapshot if within is None else within)
    # one date's candidates feed several results, so they are stored once
    scored = cut_lineage(scored.withColumns({"why_flagged": explanation(scored.columns), "risk_flags": risk_flags(scored.columns, config)}))
    return {"candidates": scored, "exclusions": excluded, "watchlists": watchlists(scored, config)}


def top_fraction(df: DataFrame, fraction: float, keys=("date",)) -> DataFrame:
    """Best ``ceil(n * fraction)`` rows per group by discovery score, at least one."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    from panelspark.functions.crosssection import with_group_stats

    df = with_row_index(df, list(keys), [F.col("discovery_score").desc(), "symbol"], "__rank")
    df = with_group_stats(df, list(keys), {"__n": F.count("*")})
    keep = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(fraction)))
    return df.filter(F.col("__rank") <= keep).drop("__rank", "__n")
