"""Candidate monitoring, promotion, actionability and run tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.crosssection import with_row_index
from panelspark.functions.scalar import fixed, number, symbol_key, texts
from panelspark.operators.validate import optional
from panelspark.session import cut_lineage

# The columns of the monitoring state.
STATE_COLUMNS = (
    "symbol", "name", "sector", "industry", "first_seen", "last_seen", "appearances", "latest_discovery_score",
    "max_discovery_score", "latest_lanes_matched", "promotion_status", "promotion_blockers",
)


def _flag(df: DataFrame, symbols: DataFrame | None, name: str) -> DataFrame:
    if symbols is None:
        return df.withColumn(name, F.lit(False))
    known = symbols.select(symbol_key("symbol").alias("symbol"), F.lit(True).alias(name)).distinct()
    return df.join(known, "symbol", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def promotion_blockers(monitoring_days: int, min_appearances: int, min_score: float) -> Column:
    return texts(
        F.when(F.col("is_active"), "already_active_in_paper"),
        F.when(F.col("is_tracked"), "already_tracked"),
        F.when(F.col("monitoring_age_days") < monitoring_days, f"monitoring_age_below_{monitoring_days}_days"),
        F.when(F.col("appearances") < min_appearances, f"appearances_below_{min_appearances}"),
        F.when(F.coalesce("discovery_score", F.lit(0.0)) < min_score, f"discovery_score_below_{min_score:g}"),
    )


def monitoring_candidates(
    candidates: DataFrame, previous: DataFrame, membership: DataFrame, *, as_of, active: DataFrame | None = None,
    tracked: DataFrame | None = None, monitoring_days: int = 5, min_appearances: int = 3, min_score: float = 60.0,
) -> DataFrame:
    """Candidates with their lanes, history and promotion status."""
    day = F.lit(str(as_of)).cast("date")
    prior = previous.select(symbol_key("symbol").alias("symbol"), F.col("first_seen").cast("date").alias("__first"), F.col("appearances").alias("__seen"))
    df = candidates.withColumn("symbol", symbol_key("symbol")).join(membership, "symbol", "left").join(prior, "symbol", "left")
    df = _flag(_flag(df, active, "is_active"), tracked, "is_tracked")
    first = F.coalesce("__first", day)
    df = df.withColumns({
        "lanes_matched": F.coalesce("lanes_matched", F.lit("")), "lane_count": F.coalesce("lane_count", F.lit(0)),
        "first_seen": first, "last_seen": day, "appearances": F.coalesce("__seen", F.lit(0)).cast("int") + 1,
        "monitoring_age_days": F.greatest(F.datediff(day, first), F.lit(0)), "monitoring_status": F.lit("monitoring"),
    })
    df = df.withColumn("promotion_blockers", promotion_blockers(monitoring_days, min_appearances, min_score))
    status = F.when(F.col("promotion_blockers") == "", "eligible_for_review").otherwise("monitoring")
    return df.withColumn("promotion_status", status).drop("__first", "__seen", "is_active", "is_tracked")


def update_state(previous: DataFrame, candidates: DataFrame, *, as_of) -> DataFrame:
    """Keyed upsert: a candidate replaces its row and keeps the highest score seen."""
    day = F.lit(str(as_of)).cast("date")
    old = previous.select(symbol_key("symbol").alias("symbol"), *[
        optional(previous, c).alias(f"o_{c}") for c in STATE_COLUMNS if c != "symbol"])
    score = F.coalesce("discovery_score", F.lit(0.0))
    new = candidates.select(
        symbol_key("symbol").alias("symbol"), *[optional(candidates, c, F.lit("")).alias(f"n_{c}") for c in ("name", "sector", "industry")],
        F.coalesce(optional(candidates, "first_seen"), day).alias("n_first_seen"), F.coalesce(optional(candidates, "last_seen"), day).alias("n_last_seen"),
        F.coalesce(optional(candidates, "appearances"), F.lit(1)).alias("n_appearances"), score.alias("n_latest_discovery_score"),
        score.alias("n_max_discovery_score"), optional(candidates, "lanes_matched", F.lit("")).alias("n_latest_lanes_matched"),
        optional(candidates, "promotion_status", F.lit("monitoring")).alias("n_promotion_status"),
        optional(candidates, "promotion_blockers", F.lit("")).alias("n_promotion_blockers"), F.lit(True).alias("__new"),
    )
    both = old.join(new, "symbol", "full_outer")
    cols = []
    for c in STATE_COLUMNS[1:]:
        if c == "max_discovery_score":
            best = F.greatest(F.coalesce(number(f"o_{c}"), F.when(F.col("o_first_seen").isNotNull(), F.lit(0.0))), F.col(f"n_{c}"))
            cols.append(F.coalesce(best, number(f"o_{c}")).alias(c))
        else:
            cols.append(F.when(F.col("__new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c))
    return both.select("symbol", *cols)


def monitoring_summary(universe: DataFrame, eligible: DataFrame, monitored: DataFrame) -> DataFrame:
    """One row of funnel counts."""
    k = F.lit(1).alias("__k")
    parts = [
        universe.agg(F.countDistinct("symbol").alias("source_universe_count"), k),
        eligible.agg(F.count("*").alias("eligible_after_filters"), k),
        monitored.agg(F.count("*").alias("monitored_candidate_count"),
                      F.count_if(F.col("promotion_status") == "eligible_for_review").alias("promotion_candidate_count"), k),
    ]
    return parts[0].join(parts[1], "__k").join(parts[2], "__k").drop("__k")


def promotion_notes() -> Column:
    lanes = F.trim(F.coalesce("lanes_matched", F.lit("")))
    return texts(F.lit("Promoted from symbol discovery monitoring"), F.concat(F.lit("score="), fixed("discovery_score")),
                 F.when(lanes != "", F.concat(F.lit("lanes="), lanes)))


def promotion_plan(
    candidates: DataFrame, universe: DataFrame, *, max_symbols: int, min_score: float, min_lanes: int = 0, min_appearances: int = 0,
    min_age_days: int = 0, max_sector_symbols: int | None = None, category: str = "discovery",
) -> DataFrame:
    """Ready and blocked candidates under per-sector and global quotas in score order.

    Ties in the score are broken by symbol.
    """
    if max_symbols <= 0 or min(min_lanes, min_appearances, min_age_days) < 0 or (max_sector_symbols is not None and max_sector_symbols <= 0):
        raise ValueError("quotas must be positive and minimums non-negative")
    text = {c: F.coalesce(optional(candidates, c), F.lit("")) for c in ("name", "sector", "industry", "promotion_status", "lanes_matched")}
    whole = {c: F.coalesce(number(optional(candidates, c)), F.lit(0.0)).cast("int") for c in ("lane_count", "appearances", "monitoring_age_days")}
    df = candidates.withColumns({**text, **whole, "symbol": symbol_key("symbol"), "discovery_score": F.coalesce(number("discovery_score"), F.lit(0.0))})
    df = _flag(df, universe, "__tracked")
    blockers = F.array_compact(F.array(
        F.when(F.col("promotion_status") != "eligible_for_review", "not_eligible_for_review"),
        F.when(F.col("__tracked"), "already_tracked"),
        F.when(F.col("discovery_score") < min_score, f"discovery_score_below_{min_score:g}"),
        F.when(F.col("lane_count") < min_lanes, f"lane_count_below_{min_lanes}"),
        F.when(F.col("appearances") < min_appearances, f"appearances_below_{min_appearances}"),
        F.when(F.col("monitoring_age_days") < min_age_days, f"monitoring_age_below_{min_age_days}_days"),
    ))
    df = cut_lineage(df.withColumns({"__blockers": blockers, "__falling": -F.col("discovery_score")}))
    free = df.filter(F.size("__blockers") == 0)
    if max_sector_symbols is not None:
        free = with_row_index(free, ["sector"], ["__falling", "symbol"], "__in_sector")
    else:
        free = free.withColumn("__in_sector", F.lit(0))
    quota = F.lit(max_sector_symbols if max_sector_symbols is not None else 1)
    inside = F.col("__in_sector") <= quota
    # the global quota keeps few rows, so the ordered pass over survivors prunes to that many per task
    survivors = free.filter(inside).withColumn("__all", F.row_number().over(Window.orderBy("__falling", "symbol")))
    ready = survivors.filter(F.col("__all") <= max_symbols).select("symbol", F.lit(True).alias("__ready"))
    placed = df.join(free.select("symbol", "__in_sector"), "symbol", "left").join(ready, "symbol", "left")
    blocked = (
        F.when(F.size("__blockers") > 0, F.array_join("__blockers", "; "))
        .when(F.col("__in_sector") > quota, f"max_sector_symbols_{max_sector_symbols}")
        .when(F.col("__ready"), "").otherwise(f"max_symbols_limit_{max_symbols}")
    )
    dates = [optional(placed, c).alias(c) for c in ("first_seen", "last_seen")]
    return placed.select(
        "symbol", "name", F.lit(category).alias("category"), "sector", "industry", promotion_notes().alias("notes"), "discovery_score",
        "lane_count", "lanes_matched", "appearances", "monitoring_age_days", *dates,
        F.when(F.coalesce("__ready", F.lit(False)), "ready_to_promote").otherwise("blocked").alias("promotion_plan_status"),
        blocked.alias("promotion_plan_blockers"),
    )


def promotion_summary(plan: DataFrame) -> DataFrame:
    ready = F.col("promotion_plan_status") == "ready_to_promote"
    # the list is bounded by the promotion quota
    return plan.agg(
        F.count("*").alias("candidate_count"), F.count_if(ready).alias("ready_to_promote_count"), F.count_if(~ready).alias("blocked_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(ready, F.col("symbol")))), ", ").alias("ready_symbols"))


def effective_action() -> Column:
    reason = F.when(F.col("skip_reason") == "", "skipped").otherwise(F.col("skip_reason"))
    return (
        F.when(~F.col("plan_is_latest_price_date"), "stale_plan_wait_for_after_close")
        .when(F.col("already_active"), "blocked_active_symbol")
        .when((F.col("status") == "planned") & (F.col("estimated_required_cash") > F.col("cash_available")), "blocked_insufficient_cash")
        .when(F.col("status") == "planned", "actionable_new_order")
        .otherwise(F.concat(F.lit("skipped_"), reason))
    )


def actionability(orders: DataFrame, ledger: DataFrame, account: DataFrame, latest_price_date=None) -> DataFrame:
    """Each order of the day with what can be done about it. ``account`` has cash per account."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("status", "skip_reason")}
    money = {c: F.coalesce(number(optional(orders, c)), F.lit(0.0)) for c in ("score", "estimated_required_cash", "estimated_entry_value")}
    df = orders.withColumns({**text, **money, "symbol": symbol_key("symbol"), "plan_date": F.col("date").cast("date")})
    busy = ledger.filter(F.col("status").isin("planned", "open")).select("account_id", symbol_key("symbol").alias("symbol"), F.lit(True).alias("already_active")).distinct()
    df = df.join(busy, ["account_id", "symbol"], "left").join(account.select("account_id", F.col("cash").alias("cash_available")), "account_id", "left")
    fresh = F.lit(True) if latest_price_date is None else F.coalesce(F.col("plan_date") == F.lit(str(latest_price_date)).cast("date"), F.lit(True))
    df = df.withColumns({
        "already_active": F.coalesce("already_active", F.lit(False)), "cash_available": F.coalesce("cash_available", F.lit(0.0)),
        "plan_is_latest_price_date": fresh})
    df = df.withColumn("effective_action", effective_action())
    go = F.col("effective_action") == "actionable_new_order"
    return df.withColumns({"actionable_new_order": go, "cash_after_order": F.when(go, F.col("cash_available") - F.col("estimated_required_cash"))})


def actionability_summary(candidates: DataFrame) -> DataFrame:
    go = F.col("actionable_new_order")
    return candidates.groupBy("account_id").agg(
        F.count("*").alias("candidate_count"), F.count_if(F.col("status") == "planned").alias("model_planned_count"),
        F.count_if(go).alias("actionable_new_order_count"),
        F.coalesce(F.sum(F.when(go, F.col("estimated_required_cash"))), F.lit(0.0)).alias("actionable_estimated_required_cash"),
        F.count_if(F.col("effective_action") == "blocked_active_symbol").alias("blocked_by_active_symbol_count"),
        F.bool_and("plan_is_latest_price_date").alias("plan_is_latest_price_date"))


def value_counts(df: DataFrame, column: str, keys=(), blank: str = "unspecified") -> DataFrame:
    text = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(blank))
    return df.groupBy(*keys, text.alias(column)).agg(F.count("*").alias("rows"))


def monitor_summary(marks: DataFrame, ledger: DataFrame, today) -> DataFrame:
    """Per account: marks by action and sector exposure as maps, and what closed today."""
    actions = marks.groupBy("account_id", "action").agg(F.count("*").alias("n")).groupBy("account_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions"))
    sectors = marks.filter("status = 'open'").groupBy("account_id", F.coalesce("sector", F.lit("")).alias("sector")).agg(F.sum("mark_value").alias("v"))
    sectors = sectors.groupBy("account_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sector", "v")))).alias("sector_exposure"))
    closed = ledger.filter((F.col("status") == "closed") & (F.col("exit_date").cast("date") == F.lit(str(today)).cast("date")))
    closed = closed.groupBy("account_id", "exit_reason").agg(F.count("*").alias("n")).groupBy("account_id").agg(
        F.sum("n").alias("closed_today"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("exit_reason", "n")))).alias("closed_by_reason"))
    return actions.join(sectors, "account_id", "left").join(closed, "account_id", "left").fillna(0, ["closed_today"])


def next_exits(marks: DataFrame, n: int = 5) -> DataFrame:
    """Next planned exits of every account (a top-n report)."""
    order = Window.partitionBy("account_id").orderBy("target_exit_date", "symbol", "order_id")
    rows = marks.filter("status = 'open'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return rows.select("account_id", "rank", "symbol", "target_exit_date")


def tracking_assessment(closed: str = "closed_positions", errors: str = "audit_errors") -> Column:
    return (
        F.when(F.col(errors) > 0, "fix realism issues before interpreting performance")
        .when(F.col(closed) < 10, "too early for performance judgment")
        .otherwise("ready for paper-vs-backtest comparison")
    )


def tracking_summary(history: DataFrame, ledger: DataFrame, initial_capital: float = 2_000.0) -> DataFrame:
    """Per account: latest snapshot, peak equity and its fall, audit totals, closed trades, assessment."""
    runs = history.groupBy("account_id").agg(
        F.count("*").alias("history_rows"), F.min("local_time").alias("first_snapshot"), F.max("local_time").alias("latest_snapshot"),
        F.max_by("account_equity", "local_time").alias("paper_equity"), F.max("account_equity").alias("paper_peak_equity"),
        F.max_by("account_cash", "local_time").alias("paper_cash"),
        F.sum(F.coalesce("audit_error_count", F.lit(0))).alias("audit_errors"),
        F.sum(F.coalesce("audit_warning_count", F.lit(0))).alias("audit_warnings"))
    closed = F.col("status") == "closed"
    trades = ledger.groupBy("account_id").agg(
        F.count_if(F.col("status") == "open").alias("open_positions"), F.count_if(closed).alias("closed_positions"),
        F.coalesce(F.avg(F.when(closed, (F.col("net_pnl") > 0).cast("double"))), F.lit(0.0)).alias("closed_win_rate"))
    df = runs.join(trades, "account_id", "left").fillna(0, ["open_positions", "closed_positions"])
    df = df.withColumns({
        "paper_total_return": F.col("paper_equity") / initial_capital - 1.0,
        "paper_current_drawdown": F.try_divide(F.col("paper_equity"), F.col("paper_peak_equity")) - 1.0})
    return df.withColumn("assessment", tracking_assessment())


def newly_closed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Orders closed since ``before``, counted by reason."""
    known = before.filter("status = 'closed'").select("order_id")
    return after.filter("status = 'closed'").join(known, "order_id", "left_anti").groupBy("exit_reason").agg(F.count("*").alias("closed"))


def already_ran(history: DataFrame, latest_price_date) -> bool:
    """Whether an after-close run with planned orders exists for the date."""
    done = history.filter(
        (F.col("mode") == "after-close") & (F.col("latest_price_date").cast("date") == F.lit(str(latest_price_date)).cast("date"))
        & F.col("portfolio_planned_order_count").isNotNull())
    return not done.isEmpty()


def single_value(df: DataFrame, column: str, keys=()) -> DataFrame:
    """The column's only distinct value per group, or null."""
    x = F.col(column)
    return df.groupBy(*keys).agg(F.when(F.min(x) == F.max(x), F.min(x)).alias(column))


def session_symbols(*tables: DataFrame) -> DataFrame:
    """Distinct union of the symbols of several tables."""
    out = None
    for t in tables:
        part = t.select(symbol_key("symbol").alias("symbol")).filter("symbol <> ''")
        out = part if out is None else out.union(part)
    return out.distinct()
