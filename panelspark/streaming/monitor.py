"""Open positions watched on intraday marks with Structured Streaming."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelspark.functions.scalar import ratio, symbol_key
from panelspark.operators.ledger import EXIT_RULE_VERSION, LedgerConfig, normalize_ledger, since_fill, trade_cost
from panelspark.sources.files import MARK_SCHEMA, normalize_marks, path_exists
from panelspark.sources.store import TableStore

# workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INTRADAY_EXIT_RULE_VERSION = f"{EXIT_RULE_VERSION}.intraday.v1"


def read_marks(spark: SparkSession, path: str, schema=MARK_SCHEMA, lateness: str = "2 hours", **options) -> DataFrame:
    """Mark files as a stream with a watermark on their time."""
    raw = spark.readStream.schema(schema).options(**options).parquet(path)
    marks = normalize_marks(raw)
    return marks.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)


def deduplicated(marks: DataFrame, arrival: str) -> DataFrame:
    """Newest arrival per (timestamp, symbol), as the batch form keeps it; ``arrival`` orders arrivals.

    On a stream use append mode (a mark comes out once, when the watermark has passed it) or update mode (again with each newer
    arrival). State is dropped behind the watermark.
    """
    rest = [c for c in marks.columns if c not in ("timestamp", "symbol", arrival)]
    row = F.max_by(F.struct(arrival, *rest), F.col(arrival)).alias("__row")
    return marks.groupBy("timestamp", "symbol").agg(row).select("timestamp", "symbol", *[F.col("__row")[c].alias(c) for c in (arrival, *rest)])


def latest_marks(marks: DataFrame) -> DataFrame:
    """Latest mark per symbol. Works on a table, and on a stream in update mode."""
    rest = [c for c in marks.columns if c != "symbol"]
    row = F.max_by(F.struct(*rest), F.col("timestamp")).alias("__row")
    return marks.groupBy("symbol").agg(row).select("symbol", *[F.col("__row")[c].alias(c) for c in rest])


class LatestMark(StatefulProcessor):
    """Latest mark per symbol in a value state; an event-time timer tells when a symbol has had none for too long."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "micros long, price double, high double")

    def handleInputRows(self, key, rows, timerValues):
        best = before = self.state.get()
        for pdf in rows:
            if len(pdf):
                last = pdf.sort_values(["micros", "price"]).iloc[-1]
                if best is None or (int(last["micros"]), float(last["price"])) > (best[0], best[1]):
                    best = (int(last["micros"]), float(last["price"]), float(last["high"]))
        if best is None or best == before:
            return
        self.state.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[0] // 1000 + self.silence_ms)
        yield pd.DataFrame({"symbol": [key[0]], "micros": [best[0]], "price": [best[1]], "high": [best[2]], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        best = self.state.get()
        self.state.clear()
        if best is not None:
            yield pd.DataFrame({"symbol": [key[0]], "micros": [best[0]], "price": [best[1]], "high": [best[2]], "expired": [True]})

    def close(self) -> None:
        pass


def expiring_marks(marks: DataFrame, silence_ms: int) -> DataFrame:
    """Streaming form of :func:`latest_marks` whose state ends: a row per newer mark, and one with ``expired`` and the last mark once the
    watermark is ``silence_ms`` milliseconds past it.

    An expired symbol is forgotten and starts anew with its next mark, so the state holds only symbols seen lately. ``marks`` has a
    watermark on ``timestamp``. Needs the RocksDB state store provider.
    """
    rows = marks.select("symbol", "timestamp", F.unix_micros("timestamp").alias("micros"), "price", "high")
    out = rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=LatestMark(silence_ms), outputStructType="symbol string, micros long, price double, high double, expired boolean", outputMode="Append", timeMode="EventTime")
    return out.select("symbol", F.timestamp_micros("micros").alias("timestamp"), "price", "high", "expired")


def bars(marks: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Open, high, low, close and volume per symbol and (tumbling or sliding) time window."""
    window = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    return marks.groupBy(window.alias("w"), "symbol").agg(
        F.min_by("price", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("price", "timestamp").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("marks"),
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "symbol", "open", "high", "low", "close", "volume", "marks")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "timestamp", key: str = "symbol") -> DataFrame:
    """Activity sessions per key."""
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")


def daily_highs(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """Highest price of each open position since its fill date."""
    high = "high" if "high" in prices.columns else "adj_close"
    per_day = prices.select(symbol_key("symbol").alias("symbol"), F.col("date").cast("date").alias("day"), F.col(high).alias("__h")).groupBy("symbol", "day").agg(F.max("__h").alias("__h"))
    held = ledger.filter("status = 'open' and fill_date is not null").select("order_id", symbol_key("symbol").alias("symbol"), F.col("fill_date").cast("date").alias("fill_date"))
    return since_fill(held, per_day, {"daily_high": F.max("__h")}).filter("daily_high is not null").select("order_id", "daily_high")


def evaluate_exits(ledger: DataFrame, marks: DataFrame, config: LedgerConfig | None = None, prices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stop-loss and trailing-stop decisions of all open positions, and the updated ledger."""
    config = config or LedgerConfig()
    rules = config.exit_rules
    df = normalize_ledger(ledger)
    latest = latest_marks(marks.select(symbol_key("symbol").alias("symbol"), F.col("timestamp").alias("timestamp"), F.col("price").alias("price"),
                                       F.coalesce("high", "price").alias("mark_high") if "high" in marks.columns else F.col("price").alias("mark_high")))
    held = df.filter("status = 'open'").withColumn("symbol", symbol_key("symbol")).join(latest, "symbol", "left")
    if prices is not None:
        held = held.join(daily_highs(df, prices), "order_id", "left")
    else:
        held = held.withColumn("daily_high", F.lit(None).cast("double"))
    has_mark = F.col("price").isNotNull()
    highest = F.greatest("highest_close_since_entry", F.coalesce("daily_high", F.lit(0.0)), "mark_high", "price")
    value = F.col("shares") * F.col("price") - F.col("entry_value") - F.col("entry_cost")
    held = held.withColumns({
        "current_return": F.when(has_mark, F.coalesce(ratio(value, "entry_value"), F.lit(0.0))),
        "highest": F.when(has_mark, highest).otherwise(F.col("highest_close_since_entry"))})
    gain = F.coalesce(F.try_divide(F.col("highest"), F.col("entry_price")) - 1.0, F.lit(0.0))
    armed = F.col("trailing_stop_activated")
    if rules.trail_from_high_pct is not None:
        armed = armed | (has_mark & (gain >= rules.trail_activate_at))
    fall = F.coalesce(F.try_divide(F.col("price"), F.col("highest")) - 1.0, F.lit(0.0))
    held = held.withColumn("armed", armed)
    none = F.lit(None).cast("struct<reason:string,signal:double>")
    stop = trail = none
    if rules.stop_loss_pct is not None:
        stop = F.when(F.col("current_return") <= rules.stop_loss_pct, F.struct(F.lit("intraday_stop_loss").alias("reason"), F.col("current_return").alias("signal")))
    if rules.trail_from_high_pct is not None:
        trail = F.when(has_mark & F.col("armed") & (fall <= rules.trail_from_high_pct), F.struct(F.lit("intraday_trailing_stop").alias("reason"), fall.alias("signal")))
    held = held.withColumn("exit", F.coalesce(stop, trail))
    action = F.when(~has_mark, "no_mark").when(F.col("exit").isNotNull(), "exit").otherwise("hold")
    decisions = held.select(
        "order_id", "timestamp", "symbol", "status", action.alias("action"), F.col("exit").isNotNull().alias("triggered"), "price",
        "current_return", F.col("highest").alias("highest_price_since_entry"), F.col("armed").alias("trailing_stop_activated"),
        F.coalesce("exit.reason", F.lit("")).alias("exit_reason"), F.col("exit.signal").alias("exit_signal_value"))
    return decisions, apply_decisions(df, decisions, config)


def apply_decisions(ledger: DataFrame, decisions: DataFrame, config: LedgerConfig) -> DataFrame:
    """Close triggered positions, remember highs and latches of the others."""
    d = decisions.select(
        "order_id", F.col("timestamp").cast("date").alias("__day"), F.col("triggered").alias("__go"), F.col("price").alias("__p"),
        F.col("action").alias("__a"), F.col("highest_price_since_entry").alias("__h"), F.col("trailing_stop_activated").alias("__t"),
        F.col("exit_reason").alias("__r"), F.col("exit_signal_value").alias("__s"))
    df = ledger.join(d, "order_id", "left").withColumn("__go", F.coalesce("__go", F.lit(False)))
    value = F.col("shares") * F.col("__p")
    gross = value - F.col("entry_value")
    net = gross - F.col("entry_cost") - trade_cost(value, config)
    new = {
        "status": F.lit("closed"), "actual_exit_trigger_date": F.col("__day"), "exit_date": F.col("__day"), "exit_price": F.col("__p"),
        "exit_value": value, "exit_cost": trade_cost(value, config), "gross_pnl": gross, "net_pnl": net,
        "return": F.coalesce(ratio(net, "entry_value"), F.lit(0.0)), "exit_reason": F.col("__r"), "exit_signal_value": F.col("__s"),
        "exit_rule_version": F.lit(INTRADAY_EXIT_RULE_VERSION)}
    cols = {c: F.when(F.col("__go"), v).otherwise(F.col(f"`{c}`")) for c, v in new.items()}
    seen = F.col("__a").isin("exit", "hold")
    cols["highest_close_since_entry"] = F.when(seen, F.col("__h")).otherwise(F.col("highest_close_since_entry"))
    cols["trailing_stop_activated"] = F.when(seen, F.col("__t")).otherwise(F.col("trailing_stop_activated"))
    return df.withColumns(cols).drop("__day", "__go", "__p", "__a", "__h", "__t", "__r", "__s")


def decision_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("exit_reason").agg(
        F.count("*").alias("positions"), F.count_if("triggered").alias("triggered"), F.countDistinct("symbol").alias("symbols"),
        F.max("timestamp").alias("latest_timestamp"))


def decision_log(store: TableStore, before: int | None = None) -> DataFrame | None:
    """Logged decisions that are not yet in the stored ledger, with their batch; optionally of earlier batches only."""
    fs, target = store._fs(f"{store.root}/decisions")
    if not fs.exists(target):
        return None
    merged = store.note("ledger").get("decisions_upto", -1)
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    wanted = [n for n in numbers if n > merged and (before is None or n < before) and path_exists(store.spark, f"{store.root}/decisions/batch={n:09d}/_SUCCESS")]
    if not wanted:
        return None
    paths = [f"{store.root}/decisions/batch={n:09d}" for n in wanted]
    return store.spark.read.option("basePath", f"{store.root}/decisions").parquet(*paths)


def _settled(decisions: DataFrame) -> DataFrame:
    """One decision per order: its first exit, else its latest mark; highs and latches carry on from batch to batch."""
    rest = [c for c in decisions.columns if c not in ("order_id", "batch")]
    row = F.struct(*rest)
    exit_row = F.min_by(row, F.when(F.col("triggered"), F.col("batch")))
    kept = F.coalesce(exit_row, F.max_by(row, F.col("batch")))
    return decisions.groupBy("order_id").agg(kept.alias("__row")).select("order_id", *[F.col("__row")[c].alias(c) for c in rest])


def monitored_ledger(store: TableStore, config: LedgerConfig, before: int | None = None) -> DataFrame | None:
    """The stored ledger with all logged decisions merged on read; ``before`` leaves later batches out."""
    ledger = store.read("ledger")
    if ledger is None:
        return None
    ledger, log = normalize_ledger(ledger), decision_log(store, before)
    return ledger if log is None else apply_decisions(ledger, _settled(log), config)


def compact_decisions(store: TableStore, config: LedgerConfig) -> int | None:
    """Write the merged ledger as a new version that covers the logged batches, and return the last of them.

    The version notes how far it goes in the same commit, so readers never merge a batch twice.
    """
    log = decision_log(store)
    if log is None:
        return None
    upto = log.agg(F.max("batch")).first()[0]
    if upto is None:  # batches without a decision
        return None
    settled = _settled(log.filter(F.col("batch") <= upto))
    store.change("ledger", lambda old: apply_decisions(normalize_ledger(old), settled, config), {"decisions_upto": int(upto)})
    return int(upto)


def monitor_batch(store: TableStore, config: LedgerConfig, prices: DataFrame | None = None, compact_every: int | None = 100):
    """A ``foreachBatch`` function: one monitoring cycle per micro-batch.

    A batch appends the decisions that change something to a log, in a folder named by its id; the ledger itself is not written.
    What a batch decides depends on the ledger and on earlier batches only, so a repeated batch decides the same and reuses a
    finished folder. Every ``compact_every`` batches the log is merged into the ledger.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        ledger = monitored_ledger(store, config, batch_id)
        if ledger is None or batch.isEmpty():
            return
        path = f"{store.root}/decisions/batch={batch_id:09d}"
        if not path_exists(store.spark, f"{path}/_SUCCESS") and batch_id > store.note("ledger").get("decisions_upto", -1):
            decisions, _ = evaluate_exits(ledger, batch, config, prices)
            known = ledger.select("order_id", F.col("highest_close_since_entry").alias("__h"), F.col("trailing_stop_activated").alias("__t"))
            moved = ~F.col("highest_price_since_entry").eqNullSafe(F.col("__h")) | ~F.col("trailing_stop_activated").eqNullSafe(F.col("__t"))
            changed = decisions.filter("action <> 'no_mark'").join(known, "order_id").filter(F.col("triggered") | moved).drop("__h", "__t")
            changed.write.mode("overwrite").parquet(path)
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_decisions(store, config)

    return cycle


def start_monitor(marks: DataFrame, store: TableStore, config: LedgerConfig, checkpoint: str, *, prices: DataFrame | None = None,
                  compact_every: int | None = 100, available_now: bool = False, every: str = "1 minute"):
    """Start the monitoring query; ``available_now`` works through what is there and stops."""
    writer = marks.writeStream.foreachBatch(monitor_batch(store, config, prices, compact_every)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
