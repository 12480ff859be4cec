"""The research frame: prices to features and labels in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelspark.operators import evaluation, features, labels, validate


def research_frame(
    prices: DataFrame,
    universe: DataFrame,
    *,
    benchmark_symbol: str = "SPY",
    benchmark: DataFrame | None = None,
    horizons=(5,),
    **feature_options,
) -> DataFrame:
    """Features, sector and market relatives, and labels keyed by (symbol, date).

    Two exchanges carry the wide frame: one on symbol for every per-symbol window and label, one on
    (date, sector) for the cross-section. Market data arrives by broadcast. Work that needs the symbol
    order is done before the cross-section so that the frame is not shuffled back.
    """
    if benchmark is None:
        prices, benchmark = validate.split_benchmark(prices, benchmark_symbol)
    windows = feature_options.get("windows", features.RETURN_WINDOWS)
    cross = {k: feature_options.pop(k, False) for k in ("cross_sectional", "factors")}
    df = features.price_features(prices, **feature_options)
    df = features.market_relative_features(df, benchmark, windows)
    df = labels.forward_labels(df, benchmark, horizons)
    df = features.sector_relative_features(df, universe, windows)
    if cross["cross_sectional"]:
        df = features.cross_sectional_features(df, windows)
    if cross["factors"]:
        df = features.factor_proxies(df, windows)
    return df


def momentum_evaluation(
    frame: DataFrame, score: str = "momentum_20d", outcome: str = "fwd_5d_return", config=None,
) -> DataFrame:
    """Trailing return as a placeholder score, evaluated long/short per date."""
    scored = frame.select("date", "symbol", frame[score].alias("score"), frame[outcome].alias("forward_return"))
    return evaluation.long_short_returns(scored, config or evaluation.EvaluationConfig())
