"""The order ledger as keyed tables: plan, fill, exit, accrue, mark and summarise.

The reference state of an order is one row. Everything that does not depend on an account's cash is
relational over all orders at once; greedy cash goes through :func:`greedy_accept`.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.calendar import add_business_days, business_days_between
from panelspark.functions.crosssection import BROADCAST_GROUPS, null_safe_join, with_row_index
from panelspark.functions.scalar import number, ratio, symbol_key, zero_padded
from panelspark.functions.windows import running_max
from panelspark.operators import folds
from panelspark.operators.asof import asof_lookup, latest_per_key
from panelspark.operators.features import sector_return_table, volatility_table
from panelspark.session import cut_lineage

# Ledger columns by type, statuses and version tags of the ledger contract.
DATE_COLUMNS = ("planned_date", "target_exit_date", "actual_exit_trigger_date", "fill_date", "exit_date")
NUMBER_COLUMNS = (
    "score", "shares", "reference_price", "estimated_entry_value", "estimated_cost", "entry_price",
    "entry_value", "entry_cost", "exit_price", "exit_value", "exit_cost", "gross_pnl", "net_pnl", "return",
    "exit_signal_value", "highest_close_since_entry", "requested_shares", "filled_shares", "borrow_cost", "dividends",
)
TEXT_COLUMNS = ("exit_reason", "exit_rule_version", "skip_reason")
LEDGER_COLUMNS = (
    "order_id", "status", "planned_date", "symbol", "sector", "score", "shares", "reference_price",
    "estimated_entry_value", "estimated_cost", "target_exit_date", "actual_exit_trigger_date", "fill_date",
    "entry_price", "entry_value", "entry_cost", "exit_date", "exit_price", "exit_value", "exit_cost", "gross_pnl",
    "net_pnl", "return", "exit_reason", "exit_signal_value", "exit_rule_version", "highest_close_since_entry",
    "trailing_stop_activated", "skip_reason", "requested_shares", "filled_shares", "borrow_cost", "dividends",
)
EXIT_RULE_VERSION = "exit_rules.v2"


@dataclass(frozen=True)
class ExitRules:
    """Exit rule settings. A rule with ``None`` as its main threshold is off."""

    horizon_days: int = 20
    stop_loss_pct: float | None = None
    trail_activate_at: float = 0.12
    trail_from_high_pct: float | None = None
    vol_trail_multiple: float | None = None
    vol_trail_activate_at: float = 0.12
    vol_trail_lookback: int = 20
    vol_trail_tightest: float = -0.03
    vol_trail_widest: float = -0.15
    sector_decline_pct: float | None = None
    sector_lookback: int = 5
    sector_min_records: int = 3
    score_exit_below: float | None = None
    score_decline_pct: float = 0.60
    score_min_days: int = 5
    rebalance_exit_below: float | None = None
    rebalance_min_days: int = 10
    decay_half_life: int | None = None
    decay_min_days: int = 2
    decay_min_score: float = 0.005

    @staticmethod
    def enabled(**changes) -> "ExitRules":
        """All rules on, at the standard thresholds."""
        rules = ExitRules(
            stop_loss_pct=-0.08, trail_from_high_pct=-0.06, vol_trail_multiple=2.0, sector_decline_pct=-0.05,
            score_exit_below=0.005, rebalance_exit_below=0.01, decay_half_life=10,
        )
        return replace(rules, **changes)


@dataclass(frozen=True)
class LedgerConfig:
    initial_capital: float = 2_000.0
    position_weight: float = 0.10
    long_fraction: float = 0.10
    min_score: float = 0.01
    horizon: int = 20
    transaction_cost_bps: float = 5.0
    slippage_bps: float = 5.0
    allow_fractional_shares: bool = False
    exit_rules: ExitRules = field(default_factory=ExitRules)
    fill_pct: float = 1.0
    min_fill_pct: float = 0.1
    borrow_rate: float | None = None
    hard_to_borrow_rate: float = 0.50
    hard_to_borrow_symbols: tuple[str, ...] = ()
    dividend_yield: float | None = None

    def __post_init__(self):
        if self.initial_capital <= 0 or self.horizon <= 0 or self.exit_rules.horizon_days <= 0:
            raise ValueError("capital and horizons must be positive")
        for name in ("position_weight", "long_fraction"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in (0, 1]")
        if self.transaction_cost_bps < 0 or self.slippage_bps < 0:
            raise ValueError("costs must be non-negative")

    @property
    def cost_rate(self) -> float:
        return (self.transaction_cost_bps + self.slippage_bps) / 10_000.0

    @property
    def horizon_days(self) -> int:
        changed = self.exit_rules.horizon_days
        return changed if changed != ExitRules().horizon_days else self.horizon


def trade_cost(value, config: LedgerConfig) -> Column:
    return (F.col(value) if isinstance(value, str) else value) * F.lit(config.cost_rate)


def adjusted_open() -> Column:
    return F.col("open") * ratio("adj_close", "close")


def shares_for(target, price, fractional: bool) -> Column:
    """Shares a budget buys; 0 for a non-positive price."""
    p = F.col(price) if isinstance(price, str) else price
    raw = F.try_divide(F.lit(target) if isinstance(target, float) else target, F.when(p > 0, p))
    return F.coalesce(raw if fractional else F.floor(raw).cast("double"), F.lit(0.0))


def normalize_ledger(df: DataFrame) -> DataFrame:
    """All ledger columns with their types: missing numbers 0, missing texts empty; extras are kept."""
    have = set(df.columns)

    def get(c):
        return F.col(f"`{c}`") if c in have else F.lit(None)

    cols = {c: get(c).cast("date") for c in DATE_COLUMNS}
    cols |= {c: F.coalesce(get(c).cast("string").try_cast("double"), F.lit(0.0)) for c in NUMBER_COLUMNS}
    cols |= {c: F.coalesce(get(c).cast("string"), F.lit("")) for c in TEXT_COLUMNS}
    cols["trailing_stop_activated"] = F.coalesce(get("trailing_stop_activated").cast("boolean"), F.lit(False))
    for c in ("order_id", "status", "symbol", "sector"):
        cols[c] = get(c).cast("string")
    extras = [c for c in df.columns if c not in LEDGER_COLUMNS]
    return df.withColumns(cols).select(*extras, *[F.col(f"`{c}`") for c in LEDGER_COLUMNS])


def skip_where(df: DataFrame, condition: Column, reason) -> DataFrame:
    """Reset an order to the skipped state where ``condition`` holds."""
    none_date, none = F.lit(None).cast("date"), F.lit(None).cast("double")
    reset = {c: F.lit(0.0) for c in (
        "shares", "estimated_entry_value", "estimated_cost", "entry_value", "entry_cost", "exit_value", "exit_cost",
        "gross_pnl", "net_pnl", "return", "requested_shares", "filled_shares", "borrow_cost", "dividends")}
    reset |= {c: none_date for c in ("fill_date", "exit_date", "actual_exit_trigger_date")}
    reset |= {c: none for c in ("entry_price", "exit_price", "exit_signal_value", "highest_close_since_entry")}
    reset |= {"exit_reason": F.lit(""), "exit_rule_version": F.lit(""), "trailing_stop_activated": F.lit(False),
              "status": F.lit("skipped"), "skip_reason": F.lit(reason) if isinstance(reason, str) else reason}
    hit = F.coalesce(condition, F.lit(False))
    df = df.withColumn("__skip", hit)
    return df.withColumns({c: F.when(F.col("__skip"), v).otherwise(F.col(f"`{c}`")) for c, v in reset.items()}).drop("__skip")


def is_active(status="status") -> Column:
    return F.col(status).isin("planned", "filling", "open")


def dedupe_active(df: DataFrame, keys=("account_id",)) -> DataFrame:
    """Keep the first active order per symbol and account; later ones become skipped.

    A symbol of an account has at most one order per plan date, so the group is calendar-bounded.
    """
    order = Window.partitionBy(*keys, F.upper("symbol"), is_active()).orderBy(
        "planned_date", F.col("fill_date").asc_nulls_last(), "order_id")
    later = is_active() & (F.row_number().over(order) > 1)
    return skip_where(df.withColumn("__later", later), F.col("__later"), "duplicate_active_symbol").drop("__later")


def order_ids(df: DataFrame, date: str = "planned_date", keys=(), order=("rank",)) -> DataFrame:
    """Stable text id from date, symbol and position; a date may hold any share of the rows."""
    placed = with_row_index(df, [*keys, date], order, "__position")
    return placed.withColumn("order_id", F.concat_ws("-", F.date_format(date, "yyyy-MM-dd"), "symbol", zero_padded("__position"))).drop("__position")


def target_exit_date(day, config: LedgerConfig) -> Column:
    return add_business_days(day, F.lit(config.horizon_days))


def current_cash(ledger: DataFrame, config: LedgerConfig, keys=("account_id",)) -> DataFrame:
    """Cash per account from filled and closed orders, partial fills included."""
    spent = F.when(F.col("status").isin("open", "closed", "filling"), F.col("entry_value") + F.col("entry_cost"))
    back = F.when(F.col("status") == "closed", F.col("exit_value") - F.col("exit_cost"))
    zero = F.lit(0.0)
    return ledger.groupBy(*keys).agg(
        (F.lit(config.initial_capital) - F.coalesce(F.sum(spent), zero) + F.coalesce(F.sum(back), zero)).alias("cash"))


def greedy_accept(rows: DataFrame, keys, order, lookahead: int = 256) -> DataFrame:
    """Accept rows in order while their ``need`` fits the remaining ``cash`` of the key.

    ``rows`` carry ``need``, ``cash`` and ``limit`` (a count). Only the first ``lookahead`` rows of a key
    reach the sequential step: tasks prune to that many before the shuffle. A key stops early once its
    limit is reached or less is left than the cheapest need; a key that did not stop gets a longer
    lookahead and the job is repeated, so the outcome is exact for any size.

    Returns ``rows`` with ``accepted`` and ``stopped`` (the reason that ended the key, set on rows after
    the end).
    """
    keys, order = list(keys), list(order)
    cheapest = rows.groupBy(*keys).agg(F.min("need").alias("cheapest"), F.count("*").alias("viable"))
    place = Window.partitionBy(*keys).orderBy(*order)
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], folds.GREEDY_COLUMNS])
    limit = lookahead

    def run(key, pdf):
        out = folds.frame_of(folds.greedy_fold(pdf), folds.GREEDY_COLUMNS)
        for at, name in enumerate(keys):
            out.insert(at, name, key[at])
        return out

    while True:
        top = rows.withColumn("pos", F.row_number().over(place)).filter(F.col("pos") <= limit)
        slim = null_safe_join(top.select(*keys, "pos", "need", "cash", "limit"), cheapest, keys)
        result = cut_lineage(slim.groupBy(*keys).applyInPandas(run, schema))
        if result.filter("kind = 'more'").isEmpty():
            break
        limit *= 8
    taken = result.filter("accepted").select(*keys, "pos", "accepted")
    ends = result.filter("kind is not null").select(*keys, F.col("pos").alias("__end"), "kind")
    # positions beyond the lookahead are only compared with the end, so they share one value
    numbered = rows.join(top.select(*keys, *_names(order), "pos"), [*keys, *_names(order)], "left")
    numbered = numbered.withColumn("pos", F.coalesce("pos", F.lit(limit + 1)))
    out = null_safe_join(null_safe_join(numbered, taken, [*keys, "pos"]), ends, keys)
    return out.withColumns({
        "accepted": F.coalesce("accepted", F.lit(False)),
        "stopped": F.when(F.col("pos") > F.col("__end"), F.col("kind")),
    }).drop("pos", "__end", "kind")


def _names(order) -> list[str]:
    return [o for o in order if isinstance(o, str)]


def plan_orders(
    scored: DataFrame, config: LedgerConfig | None = None, *, keys=("account_id",), cash: DataFrame | None = None,
    active: DataFrame | None = None,
) -> DataFrame:
    """Planned and skipped orders of every (account, date), from scored candidates.

    ``cash`` holds the available cash per key, ``active`` the symbols that must not be ordered again.
    Ties in the score are broken by symbol.
    """
    config = config or LedgerConfig()
    keys = list(keys)
    groups = [*keys, "date"]
    df = scored.withColumns({"symbol": symbol_key("symbol"), "score": number("score")})
    if active is not None:
        known = active.select(*[k for k in keys if k in active.columns], F.upper("symbol").alias("symbol"), F.lit(True).alias("__open")).distinct()
        df = df.join(known, [*[k for k in keys if k in active.columns], "symbol"], "left")
    else:
        df = df.withColumn("__open", F.lit(None).cast("boolean"))
    budget = config.initial_capital * config.position_weight
    shares = shares_for(budget, "adj_close", config.allow_fractional_shares)
    df = df.withColumn("shares", shares)
    df = df.withColumn("estimated_entry_value", F.col("shares") * F.col("adj_close"))
    df = df.withColumn("estimated_cost", trade_cost("estimated_entry_value", config))
    df = df.withColumn("estimated_required_cash", F.col("estimated_entry_value") + F.col("estimated_cost"))
    early = F.when(F.coalesce("__open", F.lit(False)), "symbol_already_open").when(
        ~F.coalesce(F.col("score") >= config.min_score, F.lit(False)), "score_below_threshold")
    # stored once: counting, accepting and labelling all read it
    df = cut_lineage(df.withColumns({"__early": early, "__falling": -F.col("score")}))
    counts = df.groupBy(*groups).agg(F.count("*").alias("__rows"))
    limit = F.greatest(F.lit(1), F.floor(F.col("__rows") * F.lit(config.long_fraction))).alias("limit")
    open_rows = df.filter("__early is null")
    viable = open_rows.filter("shares > 0 and estimated_required_cash > 0").select(
        *groups, "symbol", "__falling", F.col("estimated_required_cash").alias("need"))
    viable = null_safe_join(viable, counts.select(*groups, limit), groups)
    if cash is None:
        funds = counts.select(*groups, F.lit(config.initial_capital).alias("cash"))
    else:
        funds = counts.select(*groups).join(cash, [c for c in keys if c in cash.columns], "left").select(
            *groups, F.coalesce("cash", F.lit(config.initial_capital)).alias("cash"))
    viable = null_safe_join(viable, funds, groups)
    decided = greedy_accept(viable, groups, ["__falling", "symbol"])
    # rows too small to buy are classified by whether the count limit was reached before them
    last = decided.filter("accepted").groupBy(*groups).agg(
        F.max(F.struct("__falling", "symbol")).alias("__last"), F.count("*").alias("__taken"),
        # bounded by what the cash can buy
        F.collect_list(F.struct(F.struct("__falling", "symbol").alias("at"), "need")).alias("__bought"))
    marks = decided.select(*groups, "symbol", "accepted")
    out = df.join(marks, [*groups, "symbol"], "left")
    out = null_safe_join(null_safe_join(out, last, groups), counts.select(*groups, limit), groups)
    full = (F.col("__taken") >= F.col("limit")) & (F.struct("__falling", "symbol") > F.col("__last"))
    reason = (
        F.when(F.coalesce("accepted", F.lit(False)), "")
        .when(F.col("__early").isNotNull(), F.col("__early"))
        .when(F.coalesce(full, F.lit(False)), "rank_below_position_count")
        .when((F.col("shares") <= 0) | (F.col("estimated_required_cash") <= 0), "size_too_small")
        .otherwise("insufficient_cash")
    )
    out = out.withColumn("skip_reason", reason)
    planned = F.col("skip_reason") == ""
    zero = {c: F.when(planned, F.col(c)).otherwise(0.0) for c in ("shares", "estimated_entry_value", "estimated_cost", "estimated_required_cash")}
    out = out.withColumns({**zero, "status": F.when(planned, "planned").otherwise("skipped"),
                           "target_exit_date": target_exit_date("date", config)})
    out = with_row_index(null_safe_join(out, funds, groups), groups, ["__falling", "symbol"], "rank")
    here = F.struct("__falling", "symbol")
    before = F.filter(F.coalesce("__bought", F.array().cast(out.schema["__bought"].dataType)), lambda x: x["at"] <= here)
    left = F.col("cash") - F.aggregate(before, F.lit(0.0), lambda a, x: a + x["need"])
    sector = F.col("sector") if "sector" in out.columns else F.lit("")
    return out.select(
        *keys, F.col("date").alias("planned_date"), "symbol", sector.alias("sector"), "score", "status", "skip_reason",
        F.col("adj_close").alias("reference_price"), "shares", "estimated_entry_value", "estimated_cost",
        "estimated_required_cash", "target_exit_date", "rank", left.alias("remaining_cash"),
        F.col("shares").alias("requested_shares"), F.lit(0.0).alias("filled_shares"),
    )


def append_new_orders(existing: DataFrame, planned: DataFrame, keys=("account_id",)) -> DataFrame:
    """Planned rows whose id is new, whose symbol is not active and whose (date, symbol) is unknown."""
    keys = list(keys)
    new = planned.filter("status = 'planned'")
    new = new.join(existing.select(*keys, "order_id").distinct(), [*keys, "order_id"], "left_anti")
    busy = existing.filter(is_active()).select(*keys, F.upper("symbol").alias("symbol")).distinct()
    new = new.join(busy, [*keys, "symbol"], "left_anti")
    seen = existing.select(*keys, "planned_date", F.upper("symbol").alias("symbol")).distinct()
    return new.join(seen, [*keys, "planned_date", "symbol"], "left_anti")


def reconcile_fills(ledger: DataFrame, prices: DataFrame, config: LedgerConfig | None = None, keys=("account_id",)) -> DataFrame:
    """Fill waiting orders at the first open strictly after their plan (or last fill) date."""
    config = config or LedgerConfig()
    keys = list(keys)
    df = dedupe_active(normalize_ledger(ledger), keys)
    df = df.withColumn("__from", F.coalesce("fill_date", "planned_date"))
    bars = prices.select(symbol_key("symbol").alias("symbol"), F.col("date").cast("date").alias("__day"), adjusted_open().alias("__open"))
    waiting = df.filter(F.col("status").isin("planned", "filling"))
    rest = df.filter(~F.col("status").isin("planned", "filling")).drop("__from")
    hit = asof_lookup(waiting, bars, by="symbol", left_on="__from", right_on="__day", values=["__open"], direction="forward", strict=True)
    remaining = F.col("requested_shares") - F.col("filled_shares")
    hit = hit.withColumn("__left", remaining)
    if config.fill_pct < 1.0:
        part = F.greatest(F.col("__left") * config.fill_pct, F.col("__left") * config.min_fill_pct)
        total = F.col("filled_shares") + part
        close = F.greatest(F.lit(0.0), F.col("requested_shares") - total) <= F.col("requested_shares") * config.min_fill_pct
        total = F.when(close, F.col("requested_shares")).otherwise(total)
        if not config.allow_fractional_shares:
            total = F.floor(total).cast("double")
        total = F.least(total, F.col("requested_shares"))
    else:
        total = F.col("requested_shares")
    hit = hit.withColumn("__total", total)
    hit = hit.withColumn("__attempt", F.col("__total") - F.col("filled_shares"))
    hit = hit.withColumn("__value", F.col("__attempt") * F.col("__open"))
    tries = F.col("__open").isNotNull() & (F.col("__left") > 0) & (F.col("__attempt") > 0)
    hit = hit.withColumn("__need", F.when(tries, F.col("__value") + trade_cost("__value", config)))
    queue = hit.filter("__need is not null").select(*keys, "planned_date", "order_id", F.col("__need").alias("need"))
    queue = cut_lineage(queue.join(current_cash(df, config, keys), keys).withColumn("limit", F.lit(2**31 - 1).cast("long")))
    decided = greedy_accept(queue, keys, ["planned_date", "order_id"], 1024).select(*keys, "planned_date", "order_id", "accepted")
    hit = hit.join(decided, [*keys, "planned_date", "order_id"], "left")
    ok = F.coalesce("accepted", F.lit(False))
    value = F.col("entry_value") + F.col("__value")
    final = F.col("__total") >= F.col("requested_shares") - 0.001
    # an order with nothing left to fill is open
    done = (F.col("status") == "filling") & (F.col("__left") <= 0) & F.col("__open").isNotNull()
    hit = hit.withColumn("__ok", ok)
    filled = hit.withColumns({
        "status": F.when(F.col("__ok"), F.when(final, "open").otherwise("filling")).when(done, "open").otherwise(F.col("status")),
        "fill_date": F.when(F.col("__ok"), F.col("__day")).otherwise(F.col("fill_date")),
        "entry_price": F.when(F.col("__ok"), ratio(value, "__total")).otherwise(F.col("entry_price")),
        "entry_value": F.when(F.col("__ok"), value).otherwise(F.col("entry_value")),
        "entry_cost": F.when(F.col("__ok"), F.col("entry_cost") + trade_cost("__value", config)).otherwise(F.col("entry_cost")),
        "shares": F.when(F.col("__ok"), F.col("__total")).otherwise(F.col("shares")),
        "filled_shares": F.when(F.col("__ok"), F.col("__total")).otherwise(F.col("filled_shares")),
    })
    empty = F.col("__open").isNotNull() & (F.col("__left") > 0) & (F.col("__attempt") <= 0)
    broke = F.col("__need").isNotNull() & ~F.col("__ok")
    filled = skip_where(filled.withColumn("__empty", empty), F.col("__empty"), "fill_size_zero")
    filled = skip_where(filled, broke, "insufficient_cash_at_fill")
    return rest.unionByName(filled.select(*rest.columns))


def attach_scores(df: DataFrame, scores: DataFrame | None, out: str = "current_score", exact: bool = True) -> DataFrame:
    """Score of the row's symbol on its date, or with ``exact=False`` the latest one up to it."""
    if scores is None or not {"symbol", "score", "date"} <= set(scores.columns):
        return df.withColumn(out, F.lit(None).cast("double"))
    table = scores.select(symbol_key("symbol").alias("symbol"), F.col("date").cast("date").alias("__sd"), number("score").alias(out))
    table = table.filter(F.col(out).isNotNull())
    if exact:
        table = table.withColumnRenamed("__sd", "date").dropDuplicates(["symbol", "date"])
        return df.join(table, ["symbol", "date"], "left")
    return asof_lookup(df, table, by="symbol", left_on="date", right_on="__sd", values=[out]).drop("__sd")


def exit_case(rules: ExitRules) -> Column:
    """First rule that fires on a position-day, as (reason, signal); null if none does."""

    def hit(condition, reason, signal):
        return F.when(condition, F.struct(F.lit(reason).alias("reason"), signal.cast("double").alias("signal")))

    close, high = F.col("close_price"), F.col("high_close")
    armed, days, score = F.col("trail_armed"), F.col("days_held"), F.col("current_score")
    fall = F.coalesce(F.try_divide(close, high) - 1.0, F.lit(0.0))
    cases = []
    if rules.stop_loss_pct is not None:
        cases.append(hit(F.col("current_return") <= rules.stop_loss_pct, "stop_loss", F.col("current_return")))
    if rules.trail_from_high_pct is not None:
        cases.append(hit(armed & (fall <= rules.trail_from_high_pct), "trailing_stop", fall))
    if rules.vol_trail_multiple is not None:
        width = F.greatest(F.least(-F.col("volatility") * rules.vol_trail_multiple, F.lit(rules.vol_trail_tightest)),
                           F.lit(rules.vol_trail_widest))
        cases.append(hit(armed & F.col("volatility").isNotNull() & (fall <= width), "trailing_volatility_stop", fall))
    if rules.sector_decline_pct is not None:
        cases.append(hit(F.col("sector_return") <= rules.sector_decline_pct, "sector_stop", F.col("sector_return")))
    if rules.score_exit_below is not None:
        decline = F.coalesce(F.try_divide(F.col("score") - score, F.abs("score")), F.lit(0.0))
        worse = (score <= rules.score_exit_below) | (decline >= rules.score_decline_pct)
        cases.append(hit((days >= rules.score_min_days) & score.isNotNull() & worse, "score_deterioration", score))
    if rules.rebalance_exit_below is not None:
        cases.append(hit((days >= rules.rebalance_min_days) & (score <= rules.rebalance_exit_below), "rebalance", score))
    if rules.decay_half_life is not None:
        entry = F.when(F.col("score") > 0, F.col("score"))
        hold = (F.lit(float(rules.decay_half_life)) * F.log2(entry / rules.decay_min_score)).cast("int")
        left = F.pow(F.lit(0.5), days / float(rules.decay_half_life))
        cases.append(hit((days >= rules.decay_min_days) & (days >= hold), "time_decay", left))
    cases.append(hit(F.col("day") >= F.col("target_exit_date"), "horizon", F.col("current_return")))
    return F.coalesce(*cases)


#: Bars of a block; an order opens the blocks from its fill to its horizon.
BAR_BLOCK = 32


def since_fill(held: DataFrame, bars: DataFrame, stats: dict[str, Column], day: str = "day") -> DataFrame:
    """``held`` with figures over all bars of its symbol from the fill date to the end.

    ``stats`` are aggregates of the bars. The range always ends at a symbol's last bar, so they are running aggregates from the end
    of its history, looked up at the first bar on or after the fill date: no order meets more than one bar.
    """
    to_end = Window.partitionBy("symbol").orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    running = bars.select("symbol", day, *(stat.over(to_end).alias(name) for name, stat in stats.items()))
    return asof_lookup(held, running, by="symbol", left_on="fill_date", right_on=day, values=list(stats), direction="forward").drop(day)


def held_bars(pos: DataFrame, bars: DataFrame) -> DataFrame:
    """Every position with its symbol's bars from the fill date to the first one on or after the target exit date.

    No rule can fire later than the horizon does. Bars are numbered per symbol and kept in blocks; a position meets the blocks
    between its two numbers by equality, so it reads its holding period and at most two blocks' rest.
    """
    order = Window.partitionBy("symbol").orderBy("day")
    numbered = bars.withColumn("__at", F.row_number().over(order) - 1)
    spot = numbered.select("symbol", "day", "__at")
    pos = asof_lookup(pos, spot.withColumnRenamed("day", "__fill_bar"), by="symbol", left_on="fill_date", right_on="__fill_bar", values=["__at"], direction="forward")
    pos = pos.filter("__at is not null").withColumnRenamed("__at", "__from").drop("__fill_bar").withColumn("__due", F.greatest("fill_date", "target_exit_date"))
    pos = pos.withColumn("__due", F.when(F.col("target_exit_date").isNotNull(), F.col("__due")))
    pos = asof_lookup(pos, spot.withColumnRenamed("day", "__due_bar"), by="symbol", left_on="__due", right_on="__due_bar", values=["__at"], direction="forward")
    last = numbered.groupBy("symbol").agg(F.max("__at").alias("__last"))
    pos = pos.withColumnRenamed("__at", "__to").drop("__due", "__due_bar").join(last, "symbol").withColumn("__to", F.coalesce("__to", "__last")).drop("__last")
    values = [c for c in bars.columns if c != "symbol"]
    blocks = numbered.groupBy("symbol", F.floor(F.col("__at") / BAR_BLOCK).alias("__block")).agg(F.collect_list(F.struct("__at", *values)).alias("__bars"))
    opened = pos.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__from") / BAR_BLOCK), F.floor(F.col("__to") / BAR_BLOCK))))
    met = opened.join(blocks, ["symbol", "__block"]).withColumn("__bar", F.explode(F.filter("__bars", lambda x: x["__at"].between(F.col("__from"), F.col("__to")))))
    return met.select(*[c for c in pos.columns if c not in ("__from", "__to")], *(F.col("__bar")[c].alias(c) for c in values))


def bars_of(prices: DataFrame) -> DataFrame:
    return prices.select(symbol_key("symbol").alias("symbol"), F.col("date").cast("date").alias("day"), F.col("adj_close").alias("close_price"))


def active_bars(active: DataFrame, prices: DataFrame) -> DataFrame:
    """Bars of the symbols of ``active`` orders, from the first fill of an open one on, and every symbol's last bar."""
    first = active.groupBy("symbol").agg(F.min(F.when(F.col("status") == "open", F.col("fill_date").cast("date"))).alias("__first"))
    met = bars_of(prices).join(first, "symbol").withColumn("__last", F.max("day").over(Window.partitionBy("symbol")))
    return met.filter("day >= __first or day = __last").drop("__first", "__last")


def position_days(
    open_rows: DataFrame, prices: DataFrame, config: LedgerConfig, *, scores: DataFrame | None = None,
    universe: DataFrame | None = None, bars: DataFrame | None = None,
) -> DataFrame:
    """One row per open position and trading day from its fill date to its horizon, with all exit inputs.

    The running high starts at the fill date: replaying a stored later high over earlier days would let a
    trailing stop fire in hindsight. A position's group is bounded by its holding period. ``bars`` may hold those from
    :func:`bars_of`, or fewer of them if every position's are there from its fill on.
    """
    rules = config.exit_rules
    bars = bars_of(prices) if bars is None else bars
    pos = open_rows.withColumn("symbol", F.upper("symbol")).select(
        "order_id", "symbol", "sector", "score", "shares", "fill_date", "target_exit_date", "entry_price", "entry_value",
        "entry_cost", "trailing_stop_activated")
    days = held_bars(pos, bars)
    high = running_max("close_price", ["day"], ["order_id"])
    days = days.withColumn("high_close", high)
    armed = trail_armed(rules)
    value = F.col("shares") * F.col("close_price") - F.col("entry_value") - F.col("entry_cost")
    days = days.withColumns({
        "trail_armed": armed, "current_return": F.coalesce(ratio(value, "entry_value"), F.lit(0.0)),
        "days_held": business_days_between("fill_date", "day"),
    })
    days = attach_scores(days.withColumn("date", F.col("day")), scores)
    if rules.vol_trail_multiple is not None:
        days = days.join(volatility_table(prices, rules.vol_trail_lookback), ["symbol", "date"], "left")
    else:
        days = days.withColumn("volatility", F.lit(None).cast("double"))
    if rules.sector_decline_pct is not None and universe is not None:
        # a row per sector and day: stored, and sent to the positions instead of shuffling these
        table = cut_lineage(sector_return_table(prices, universe, rules.sector_lookback, rules.sector_min_records))
        days = days.join(F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table, ["sector", "date"], "left")
    else:
        days = days.withColumn("sector_return", F.lit(None).cast("double"))
    return days.drop("date")


def trail_armed(rules: ExitRules) -> Column:
    """Whether the running high ``high_close`` has reached the level that arms the trailing stop.

    The high only rises, so comparing it with the level latches by itself.
    """
    gain = F.coalesce(F.try_divide(F.col("high_close") - F.col("entry_price"), F.col("entry_price")), F.lit(0.0))
    level = rules.vol_trail_activate_at if rules.vol_trail_multiple is not None else (
        rules.trail_activate_at if rules.trail_from_high_pct is not None else None)
    armed = F.col("trailing_stop_activated")
    return armed | (gain >= level) if level is not None else armed


def exit_decisions(days: DataFrame, rules: ExitRules) -> DataFrame:
    """First firing day per order, and the running high and latch of the last day."""
    found = days.withColumn("__x", exit_case(rules))
    fired = F.col("__x").isNotNull()
    first = F.min_by(
        F.struct("day", "close_price", "high_close", "trail_armed", F.col("__x.reason").alias("reason"), F.col("__x.signal").alias("signal")),
        F.when(fired, F.col("day")),
    )
    last = F.max_by(F.struct("high_close", "trail_armed"), F.col("day"))
    return found.groupBy("order_id").agg(F.when(F.max(fired.cast("int")) == 1, first).alias("exit"), last.alias("last"))


def reconcile_exits(
    ledger: DataFrame, prices: DataFrame, config: LedgerConfig | None = None, *, scores: DataFrame | None = None,
    universe: DataFrame | None = None,
) -> DataFrame:
    """Close open orders on the first day any rule fires; otherwise update their high and latch."""
    config = config or LedgerConfig()
    df = normalize_ledger(ledger)
    days = position_days(df.filter("status = 'open' and fill_date is not null"), prices, config, scores=scores, universe=universe)
    df = df.join(exit_decisions(days, config.exit_rules), "order_id", "left")
    x = F.col("exit")
    is_open = F.col("status") == "open"
    df = df.withColumns({"__go": is_open & x.isNotNull(), "__hold": is_open & x.isNull() & F.col("last").isNotNull()})
    value = F.col("shares") * x["close_price"]
    gross = value - F.col("entry_value") + F.col("dividends")
    net = gross - F.col("entry_cost") - trade_cost(value, config) - F.col("borrow_cost")
    new = {
        "status": F.lit("closed"), "actual_exit_trigger_date": x["day"], "exit_date": x["day"], "exit_price": x["close_price"],
        "exit_value": value, "exit_cost": trade_cost(value, config), "gross_pnl": gross, "net_pnl": net,
        "return": F.coalesce(ratio(net, "entry_value"), F.lit(0.0)), "exit_reason": x["reason"],
        "exit_signal_value": x["signal"], "exit_rule_version": F.lit(EXIT_RULE_VERSION),
    }
    cols = {c: F.when(F.col("__go"), v).otherwise(F.col(f"`{c}`")) for c, v in new.items()}
    for c, name in (("highest_close_since_entry", "high_close"), ("trailing_stop_activated", "trail_armed")):
        cols[c] = F.when(F.col("__go"), x[name]).when(F.col("__hold"), F.col("last")[name]).otherwise(F.col(c))
    return df.withColumns(cols).drop("exit", "last", "__go", "__hold")


def _with_days_held(df: DataFrame, prices: DataFrame) -> DataFrame:
    latest = prices.groupBy(symbol_key("symbol").alias("symbol")).agg(F.max(F.col("date").cast("date")).alias("__latest"))
    return df.join(latest, "symbol", "left").withColumn("__days", business_days_between("fill_date", "__latest"))


def reconcile_borrow_costs(ledger: DataFrame, prices: DataFrame, config: LedgerConfig) -> DataFrame:
    """Accrue borrow cost of open orders up to the latest price; never lowered."""
    df = normalize_ledger(ledger)
    if config.borrow_rate is None:
        return df
    df = _with_days_held(df, prices)
    hard = F.upper("symbol").isin([s.upper() for s in config.hard_to_borrow_symbols])
    rate = F.when(hard, config.hard_to_borrow_rate).otherwise(config.borrow_rate) / 365.0
    due = F.col("entry_value") * rate * F.col("__days")
    grows = (F.col("status") == "open") & F.col("__latest").isNotNull() & F.col("fill_date").isNotNull()
    cost = F.when(grows, F.greatest("borrow_cost", due)).otherwise(F.col("borrow_cost"))
    return df.withColumn("borrow_cost", cost).drop("__latest", "__days")


def reconcile_dividends(ledger: DataFrame, prices: DataFrame, config: LedgerConfig, events: DataFrame | None = None) -> DataFrame:
    """Accrue an assumed yield, or with ``events`` the dividends paid since the fill date.

    Event amounts are recomputed from the fill date, so running twice gives the same result.
    """
    df = normalize_ledger(ledger)
    if events is not None:
        paid = events.select(symbol_key("symbol").alias("symbol"), F.col("ex_date").cast("date").alias("ex_date"), "dividend_per_share")
        per_day = paid.groupBy("symbol", "ex_date").agg(F.sum("dividend_per_share").alias("__paid"))
        holds = (F.col("status") == "open") & F.col("fill_date").isNotNull()
        held = since_fill(df, per_day, {"__since": F.sum("__paid")}, "ex_date")
        df = held.withColumn("__income", F.when(holds, F.col("__since") * F.col("shares"))).drop("__since")
        new = F.when(F.col("__income") > 0, F.greatest("dividends", "__income")).otherwise(F.col("dividends"))
        return df.withColumn("dividends", new).drop("__income")
    if config.dividend_yield is None:
        return df
    df = _with_days_held(df, prices)
    due = F.col("entry_value") * (config.dividend_yield / 365.0) * F.col("__days")
    grows = (F.col("status") == "open") & F.col("__latest").isNotNull() & F.col("fill_date").isNotNull()
    income = F.when(grows, F.greatest("dividends", due)).otherwise(F.col("dividends"))
    return df.withColumn("dividends", income).drop("__latest", "__days")


def latest_marks(prices: DataFrame) -> DataFrame:
    rows = prices.select(symbol_key("symbol").alias("symbol"), F.col("date").cast("date").alias("latest_price_date"), F.col("adj_close").alias("latest_price"))
    return latest_per_key(rows, "symbol", "latest_price_date")


def account_summary(ledger: DataFrame, prices: DataFrame, config: LedgerConfig | None = None, keys=("account_id",)) -> DataFrame:
    """Cash, equity, profit and counts per account. Partly filled orders tie up cash like open ones."""
    config = config or LedgerConfig()
    df = normalize_ledger(ledger).withColumn("symbol", F.upper("symbol")).join(latest_marks(prices), "symbol", "left")
    is_open = F.col("status") == "open"
    mark = F.when(is_open | (F.col("status") == "filling"), F.col("shares") * F.col("latest_price"))
    gain = F.when(is_open & F.col("latest_price").isNotNull(), F.col("shares") * F.col("latest_price") - F.col("entry_value") - F.col("entry_cost"))
    spent = F.when(F.col("status").isin("open", "closed", "filling"), F.col("entry_value") + F.col("entry_cost"))
    closed = F.col("status") == "closed"
    zero = F.lit(0.0)
    out = df.groupBy(*keys).agg(
        F.lit(config.initial_capital).alias("initial_capital"),
        (F.lit(config.initial_capital) - F.coalesce(F.sum(spent), zero)
         + F.coalesce(F.sum(F.when(closed, F.col("exit_value") - F.col("exit_cost"))), zero)).alias("cash"),
        F.coalesce(F.sum(mark), zero).alias("__marks"),
        F.coalesce(F.sum(F.when(closed, F.col("net_pnl"))), zero).alias("realized_pnl"),
        F.coalesce(F.sum(gain), zero).alias("unrealized_pnl"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (
            ("open", "open_positions"), ("closed", "closed_positions"), ("planned", "planned_orders"), ("skipped", "skipped_orders"))],
    )
    return out.withColumn("equity", F.col("cash") + F.col("__marks")).drop("__marks")


def mark_positions(
    ledger: DataFrame, prices: DataFrame, config: LedgerConfig | None = None, *, scores: DataFrame | None = None,
    universe: DataFrame | None = None,
) -> DataFrame:
    """Latest marks of open and planned orders and what would happen to them.

    Active orders are a small part of a ledger, and their bars since the fill one of all prices; both are read by every figure and stored.
    """
    config = config or LedgerConfig()
    df = normalize_ledger(ledger).filter(F.col("status").isin("open", "planned")).withColumn("symbol", F.upper("symbol"))
    df = cut_lineage(df)
    bars = cut_lineage(active_bars(df, prices))
    if scores is not None and {"symbol", "score", "date"} <= set(scores.columns):
        table = scores.select(symbol_key("symbol").alias("symbol"), F.col("date").cast("date").alias("date"), "score")
        scores = cut_lineage(table.join(bars.select("symbol", F.col("day").alias("date")), ["symbol", "date"], "left_semi"))
    days = position_days(df.filter("status = 'open' and fill_date is not null"), prices, config, scores=scores, universe=universe, bars=bars)
    latest = latest_per_key(bars.select("symbol", F.col("day").alias("latest_price_date"), F.col("close_price").alias("latest_price")), "symbol", "latest_price_date")
    df = df.join(exit_decisions(days, config.exit_rules).drop("last"), "order_id", "left").join(latest, "symbol", "left")
    df = since_fill(df, bars, {"high_close": F.max("close_price")})
    df = df.withColumn("high_close", F.when(F.col("status") == "open", F.col("high_close")))
    df = attach_scores(df.withColumn("date", F.col("latest_price_date")), scores)
    is_open = F.col("status") == "open"
    value = F.when(is_open, F.col("shares") * F.col("latest_price")).otherwise(0.0)
    gain = F.when(is_open, value - F.col("entry_value") - F.col("entry_cost")).otherwise(0.0)
    action = F.when(~is_open, "waiting_for_fill").when(F.col("exit").isNotNull(), "exit_pending").otherwise("hold")
    return df.select(
        *[c for c in ("account_id",) if c in df.columns],
        "order_id", "status", action.alias("action"), "symbol", "sector", "planned_date", "fill_date", "target_exit_date",
        "latest_price_date", "score", "shares", "reference_price", "entry_price", "entry_value", "latest_price",
        value.alias("mark_value"), gain.alias("unrealized_pnl"),
        F.when(is_open, F.coalesce(ratio(gain, "entry_value"), F.lit(0.0))).otherwise(0.0).alias("unrealized_return"),
        business_days_between("fill_date", "latest_price_date").alias("days_open"),
        F.when(is_open, F.col("current_score")).alias("current_score"), F.col("score").alias("entry_score"),
        F.coalesce("high_close", "highest_close_since_entry").alias("highest_close_since_entry"),
        F.when(F.col("high_close").isNotNull(), trail_armed(config.exit_rules)).otherwise(F.col("trailing_stop_activated")).alias("trailing_stop_activated"),
    )


def compact(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into kept and skipped rows."""
    skipped = F.coalesce(F.col("status") == "skipped", F.lit(False))
    return ledger.filter(~skipped), ledger.filter(skipped)


def open_symbols(ledger: DataFrame) -> DataFrame:
    return ledger.filter("status = 'open'").select(F.upper("symbol").alias("symbol")).distinct()


def active_symbols(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status").isin("planned", "open")).select(F.upper("symbol").alias("symbol")).distinct()


# --- order lifecycle over history -----------------------------------------------------------------
