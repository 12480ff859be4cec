"""Lane tables: historical lane selections, their outcomes, and reports over lanes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import calendar
from panelspark.functions.scalar import change, col
from panelspark.functions.windows import lead
from panelspark.operators import discovery
from panelspark.operators.asof import latest_rows_at, mark_latest, spread_latest

LANE_ORDER = tuple(discovery.LANES)

# The display texts of the lanes.
REASON_LABELS = {
    "momentum_breakouts": "Momentum breakout candidate",
    "sector_leaders": "Sector leader candidate",
    "volume_anomalies": "Volume anomaly candidate",
    "quality_growth": "Quality growth candidate",
    "value_recoveries": "Value/recovery candidate",
}
REASON_BODIES = {
    "momentum_breakouts": "strong recent trend score and relative price strength after excluding tracked watchlist names.",
    "sector_leaders": "ranked highly versus sector peers on available price/volume/sector features.",
    "volume_anomalies": "unusual volume behavior relative to recent history.",
    "quality_growth": "ranked highly on available fundamental quality/growth inputs.",
    "value_recoveries": "recovery-style price behavior based on current price-derived features.",
}
NO_INPUTS = "No eligible candidates had usable inputs for this lane."
NO_FUNDAMENTALS = (
    "quality_growth is empty because required fundamental fields are not present "
    "in the current price/volume/sector-only research frame."
)


def rebalance_dates(panel: DataFrame, schedule: str = "monthly", start=None, end=None, date: str = "date") -> DataFrame:
    """Last available date of every month, or of every week ending on Friday."""
    if schedule not in ("monthly", "weekly"):
        raise ValueError("schedule must be 'monthly' or 'weekly'")
    d = F.col(date).cast("date")
    rows = panel.select(d.alias("__d")).filter("__d is not null")
    if start is not None:
        rows = rows.filter(F.col("__d") >= F.lit(str(start)).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("__d") <= F.lit(str(end)).cast("date"))
    period = F.trunc("__d", "month") if schedule == "monthly" else calendar.week_ending_friday("__d")
    return rows.groupBy(period.alias("__p")).agg(F.max("__d").alias("as_of_date")).select("as_of_date")


def lane_reason(lane, symbol="symbol") -> Column:
    def named(texts: dict[str, str], default: str) -> Column:
        pairs = [F.lit(x) for kv in texts.items() for x in kv]
        return F.coalesce(F.create_map(*pairs)[col(lane)], F.lit(default))

    label = named(REASON_LABELS, "Discovery candidate")
    body = named(REASON_BODIES, "ranked highly on available discovery inputs.")
    return F.concat(F.upper(col(symbol)), F.lit(" - "), label, F.lit(": "), body)


def with_forward_prices(panel: DataFrame, horizons=(5, 20, 60), price: str = "adj_close") -> DataFrame:
    return panel.withColumns({f"__fwd_{h}": lead(price, h) for h in horizons})


def needed_dates(panel: DataFrame, dates: DataFrame, days: DataFrame | None = None, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """The days on which some symbol has its latest row at one of ``dates``; one row per day. ``days`` may hold the panel's days.

    Whatever looks at a day's rows only (ranks, sector means, fundamentals) need not be computed for other days.
    """
    keys = panel.select(symbol, date)
    marked = mark_latest(keys, dates, keys.select(F.col(date).alias("date")) if days is None else days, date, symbol)
    return marked.filter("__k is not null").select(F.col(date).cast("date").alias("date")).distinct()


def lane_backtest(
    frame: DataFrame, dates: DataFrame, *, config: discovery.DiscoveryConfig | None = None, top_n: int = 25,
    horizons=(5, 20, 60), watchlist: DataFrame | None = None, within: DataFrame | None = None,
) -> DataFrame:
    """Selections of every lane on every as-of date with their later returns, in one job.

    Forward prices are taken on the panel before the snapshot, so the n-th later row of a symbol is a
    window value and not a lookup. A frame that holds some rows only (see :func:`needed_dates`) brings them along; one marked by
    :func:`mark_latest` may hold the marked rows only, and with ``__reasons`` of :func:`discovery.with_reasons` no more than the
    candidates. ``within`` may name a panel with at least the frame's rows, whose snapshots are cheaper to count.
    """
    config = replace(config or discovery.DiscoveryConfig(), top_n=top_n)
    price = config.price_col
    known = {f"__fwd_{h}" for h in horizons} <= set(frame.columns)
    panel = frame if known else with_forward_prices(frame, horizons, price)
    snapshot = spread_latest(panel, dates) if "__upto" in panel.columns else latest_rows_at(panel, dates)
    kept, _ = discovery.filter_candidates(snapshot, config, watchlist)
    if within is not None:
        keys = within.select("symbol", "date")
        within = spread_latest(mark_latest(keys, dates, keys.select("date")), dates)
    scored = discovery.score_candidates(kept, config, ["as_of_date"], snapshot if within is None else within)
    chosen = discovery.watchlists(scored, config, ["as_of_date"])
    outcome = []
    for h in horizons:
        outcome += [
            F.col(f"__fwd_{h}").alias(f"forward_price_{h}d"),
            change(f"__fwd_{h}", price).alias(f"forward_return_{h}d"),
        ]
    sector = F.col("sector") if "sector" in chosen.columns else F.lit("")
    return chosen.select(
        "as_of_date", "symbol", "lane", "rank", F.col("lane_score").alias("score"),
        F.col(price).alias("selection_price"), *outcome, sector.alias("sector"), lane_reason("lane").alias("lane_reason"),
    )


def lane_summary(trades: DataFrame, horizons=(5, 20, 60)) -> DataFrame:
    """Forward-return statistics per lane and horizon.

    A lane's group holds at most ``top_n`` rows per as-of date, so the exact median is bounded by the
    calendar.
    """
    pairs = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"forward_return_{h}d").cast("double").alias("r")) for h in horizons
    ])
    long = trades.select("lane", F.explode(pairs).alias("x")).select("lane", "x.horizon", "x.r")
    return long.groupBy("lane", "horizon").agg(
        F.count("r").alias("selections"), F.avg("r").alias("avg_forward_return"),
        F.median("r").alias("median_forward_return"),
        F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win_rate"),
        F.max("r").alias("best_return"), F.min("r").alias("worst_return"),
    )


def best_and_worst_lanes(summary: DataFrame) -> DataFrame:
    """Best and worst lane per horizon by mean forward return; ties go to the first lane name."""
    rows = summary.filter("avg_forward_return is not null")
    high = F.struct(-F.col("avg_forward_return"), F.col("lane"))
    low = F.struct(F.col("avg_forward_return"), F.col("lane"))
    return rows.groupBy("horizon").agg(
        F.min_by("lane", high).alias("best_lane"), F.max("avg_forward_return").alias("best_avg_return"),
        F.min_by("lane", low).alias("worst_lane"), F.min("avg_forward_return").alias("worst_avg_return"),
    )


def ordered_lanes(lanes) -> Column:
    """Distinct non-empty lanes, known ones in canonical order and unknown ones sorted after them."""
    found = F.array_distinct(F.filter(F.array_compact(col(lanes)), lambda x: x != ""))
    known = F.array(*[F.lit(x) for x in LANE_ORDER])
    return F.concat(F.array_intersect(known, found), F.array_sort(F.array_except(found, known)))


def lane_membership(lists: DataFrame, keys=()) -> DataFrame:
    """Lanes per symbol as a sorted text and a count. A symbol has at most one row per lane."""
    lanes = F.array_sort(F.collect_set("lane"))
    return lists.groupBy(*keys, F.upper("symbol").alias("symbol")).agg(
        F.array_join(lanes, ", ").alias("lanes_matched"), F.size(lanes).alias("lane_count")
    )


def multi_lane_candidates(lists: DataFrame, candidates: DataFrame | None = None, keys=("date",)) -> DataFrame:
    """Symbols in more than one lane, with their composite score."""
    keys = list(keys)
    lanes = ordered_lanes(F.collect_set("lane"))
    repeated = lists.groupBy(*keys, F.upper("symbol").alias("symbol")).agg(
        F.array_join(lanes, ", ").alias("lanes_matched"), F.size(lanes).alias("lane_count")
    ).filter("lane_count > 1")
    source = candidates if candidates is not None else lists
    names = [c for c in ("name", "sector", "industry") if c in source.columns]
    row = F.max_by(F.struct("discovery_score", *names), F.col("discovery_score"))
    base = source.groupBy(*keys, F.upper("symbol").alias("symbol")).agg(row.alias("__row"))
    joined = repeated.join(base, [*keys, "symbol"], "left")
    return joined.select(
        *keys, "symbol", *[F.col("__row")[c].alias(c) for c in names], "lanes_matched", "lane_count",
        F.col("__row.discovery_score").alias("composite_score"),
    )


def lane_dimension(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LANE_ORDER, start=1)), "lane_order int, lane string")


def populated_lanes(lists: DataFrame) -> DataFrame:
    """Lanes that have rows, in lane order, with their row counts."""
    counts = lists.groupBy("lane").agg(F.count("*").alias("rows"))
    return F.broadcast(lane_dimension(lists.sparkSession)).join(counts, "lane").select("lane_order", "lane", "rows")


def quality_inputs_absent(candidates: DataFrame) -> DataFrame:
    """One row: true when no candidate has the quality inputs."""
    if "quality_score_eligible" in candidates.columns:
        some = F.bool_or("quality_score_eligible")
    elif "quality_score_inputs" in candidates.columns:
        some = F.max("quality_score_inputs") > 0
    else:
        some = F.bool_or(discovery.quality_eligible(candidates.columns))
    return candidates.agg((~F.coalesce(some, F.lit(False))).alias("quality_inputs_absent"))


def missing_lane_explanations(lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """Lanes without rows and the reason."""
    lanes = lane_dimension(lists.sparkSession)
    missing = lanes.join(lists.select("lane").distinct(), "lane", "left_anti")
    absent = quality_inputs_absent(candidates).withColumn("lane", F.lit("quality_growth"))
    reason = F.when(F.coalesce("quality_inputs_absent", F.lit(False)), NO_FUNDAMENTALS).otherwise(NO_INPUTS)
    return missing.join(F.broadcast(absent), "lane", "left").select("lane", reason.alias("explanation"))


def discovery_summary(candidates: DataFrame, exclusions: DataFrame, lists: DataFrame, universe: DataFrame) -> DataFrame:
    """One row of funnel counts."""
    one = F.lit(1).alias("__k")
    known = F.contains("exclusion_reasons", F.lit("already_in_watchlist"))
    multi = lists.groupBy("symbol").agg(F.countDistinct("lane").alias("n"))
    parts = [
        candidates.agg(F.max(F.col("date").cast("date")).alias("as_of_date"), F.count("*").alias("candidate_count")),
        exclusions.agg(F.count("*").alias("exclusion_count"), F.count_if(known).alias("watchlist_exclusion_count")),
        lists.agg(*[F.count_if(F.col("lane") == lane).alias(lane) for lane in LANE_ORDER]),
        multi.agg(F.count_if(F.col("n") > 1).alias("multi_lane_candidate_count")),
        universe.agg(F.countDistinct(F.upper("symbol")).alias("source_universe_count")),
    ]
    out = parts[0].select("*", one)
    for p in parts[1:]:
        out = out.join(p.select("*", one), "__k")
    return out.drop("__k")


def lane_export(lists: DataFrame) -> DataFrame:
    """Lane rows in display order with their reason text."""
    return lists.withColumn("lane_reason", lane_reason("lane")).orderBy(
        "lane", F.col("lane_score").desc_nulls_last(), F.col("discovery_score").desc_nulls_last(),
        F.col("avg_dollar_volume_20d").desc_nulls_last(), "symbol",
    )


def candidate_export(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.col("discovery_score").desc_nulls_last(), "symbol")


def deduplicate_selections(selections: DataFrame, keys=("rebalance_date",)) -> DataFrame:
    """One row per symbol and key: the best lane row and the ordered list of its lanes."""
    score = F.col("composite_score") if "composite_score" in selections.columns else F.col("score")
    rank = F.col("rank").try_cast("double") if "rank" in selections.columns else F.lit(None).cast("double")
    rows = selections.withColumns(
        {"symbol": F.upper("symbol"), "__s": score.try_cast("double"), "__r": rank,
         "lane": F.coalesce(F.col("lane") if "lane" in selections.columns else F.lit(""), F.lit(""))}
    )
    # a symbol has at most one row per lane, so the collected set is bounded by the number of lanes
    order = F.struct(F.col("__s").isNull(), -F.col("__s"), F.col("__r").isNull(), F.col("__r"))
    lanes = ordered_lanes(F.collect_set("lane"))
    return rows.groupBy(*keys, "symbol").agg(
        F.array_join(lanes, ", ").alias("lanes_matched"), F.array_join(lanes, ", ").alias("lane_source"),
        F.size(lanes).alias("lane_count"), F.min_by(F.struct("__s", "__r"), order).alias("__best"),
    ).select(
        *keys, "symbol", "lanes_matched", "lane_source", "lane_count", F.col("__best.__s").alias("score"),
        F.col("__best.__r").alias("rank"),
    )


def compare_turnover(old: DataFrame, new: DataFrame, keys=()) -> DataFrame:
    """Sum of absolute weight changes between two weight tables."""
    pair = old.select(*keys, "symbol", F.col("weight").alias("__old")).join(
        new.select(*keys, "symbol", F.col("weight").alias("__new")), [*keys, "symbol"], "full_outer"
    )
    moved = F.abs(F.coalesce("__new", F.lit(0.0)) - F.coalesce("__old", F.lit(0.0)))
    return pair.groupBy(*keys).agg(F.sum(moved).alias("turnover"))


def running_rank(keys, order):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
