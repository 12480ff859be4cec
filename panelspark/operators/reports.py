"""Tables behind the model and contribution reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.crosssection import (
    WHOLE, group_quantiles, null_safe_join, with_percent_ranks, with_quantile_bucket,
)
from panelspark.functions.metrics import information_coefficient

REFERENCE_COLUMNS = (
    "sector", "industry", "market_return_20d", "market_return_60d", "volatility_20d", "volatility_60d",
    "log_avg_dollar_volume_20d", "sector_rank_volatility_20d",
)


def attach_reference(predictions: DataFrame, frame: DataFrame, columns=REFERENCE_COLUMNS) -> DataFrame:
    """Left join of research columns on (date, symbol), one reference row per key."""
    have = [c for c in columns if c in frame.columns]
    reference = frame.select("date", "symbol", *have).dropDuplicates(["date", "symbol"])
    return predictions.drop(*have).join(reference, ["date", "symbol"], "left")


def score_buckets(
    predictions: DataFrame, *, score: str = "score", target: str = "target", outcome: str = "forward_return", buckets: int = 10,
) -> DataFrame:
    """Statistics per split and score decile."""
    rows = predictions.dropna(subset=[score, target, outcome]).select(*dict.fromkeys(["split_id", "date", "symbol", score, target, outcome]))
    placed = with_quantile_bucket(rows, ["split_id"], score, "score_bucket", buckets, ("date", "symbol"))
    keys = ["split_id", "score_bucket"]
    table = placed.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min(score).alias("score_min"), F.avg(score).alias("score_mean"), F.max(score).alias("score_max"),
        F.avg(target).alias("mean_target"), F.avg(outcome).alias("mean_realized_return"),
        F.avg((F.col(outcome) > 0).cast("double")).alias("win_rate"))
    label = F.when(F.col("score_bucket") == buckets, "highest").when(F.col("score_bucket") == 1, "lowest").otherwise("")
    ic = information_coefficient(placed, keys, score, target, "ic_spearman")
    return table.withColumn("bucket_label", label).join(ic, keys, "left")


def bucket_overview(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("score_bucket").agg(
        F.avg("mean_realized_return").alias("mean_realized_return"), F.avg("win_rate").alias("win_rate"), F.sum("rows").alias("rows"))


def prediction_drift(predictions: DataFrame, *, score: str = "score", min_score: float = 0.01) -> DataFrame:
    """Score distribution per month."""
    rows = predictions.filter(F.col(score).isNotNull()).withColumn("month", F.date_format("date", "yyyy-MM"))
    market = [F.avg(c).alias(c) for c in ("market_return_20d", "market_return_60d") if c in rows.columns]
    table = rows.groupBy("month").agg(
        F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.avg(score).alias("score_mean"),
        F.stddev_samp(score).alias("score_std"), F.count_if(F.col(score) >= min_score).alias("above_threshold"), *market)
    marks = group_quantiles(rows, ["month"], score, {"score_p10": 0.1, "score_p50": 0.5, "score_p90": 0.9}, ("date", "symbol"))
    return table.join(marks, "month")


def sector_contribution(fills: DataFrame, frame: DataFrame, date: str = "date") -> DataFrame:
    """Filled trades per sector; trades without a sector form a group of their own."""
    reference = frame.select(F.col("date").alias(date), "symbol", "sector").dropDuplicates([date, "symbol"])
    rows = fills.filter("status = 'filled'").drop("sector").join(reference, [date, "symbol"], "left")
    return rows.groupBy("sector").agg(
        F.count("*").alias("trades"), F.countDistinct("symbol").alias("symbols"), F.sum("net_pnl").alias("net_pnl"),
        F.avg("net_pnl").alias("avg_net_pnl"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"),
        F.sum("entry_value").alias("gross_entry_value"))


def order_explanations(
    planned: DataFrame, watchlist: DataFrame, top_features: DataFrame, features, *, keys=("date",),
) -> DataFrame:
    """Planned orders with values and percentiles of the most important features, in long form."""
    features = list(features)
    keys = list(keys)
    ranked = with_percent_ranks(watchlist.select(*keys, "symbol", *features), keys, {f"__p_{f}": (f, True) for f in features}, whole=WHOLE)
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col(f"__p_{f}").alias("percentile")) for f in features])
    long = ranked.select(*keys, "symbol", F.explode(cells).alias("x")).select(*keys, "symbol", "x.*")
    wanted = long.join(top_features.select("feature"), "feature", "left_semi")
    return null_safe_join(planned.filter("status = 'planned'"), wanted, [*keys, "symbol"])


def watchlist_projection(scored: DataFrame, columns) -> DataFrame:
    have = [c for c in dict.fromkeys(["date", "symbol", "name", "sector", "score", *columns]) if c in scored.columns]
    return scored.select(*have).orderBy(F.desc("score"), "symbol")


def compare_summaries(named: dict[str, DataFrame], metrics) -> DataFrame:
    """Mean of the summary metrics per named model."""
    out = None
    for name, table in named.items():
        part = table.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.groupBy("model").agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics if m in out.columns])


def top_rows(df: DataFrame, n: int, by: str, tie: str = "symbol", keys=()) -> DataFrame:
    """The ``n`` highest rows, of every group of ``keys`` if given; tasks keep only their own ``n`` of a group before the shuffle."""
    order = [F.col(by).desc_nulls_last(), F.col(tie)]
    if not keys:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")
