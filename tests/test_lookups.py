"""As-of lookups and exits against plain loops, also where one symbol holds most orders."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import asof, ledger
from panelspark.streaming import monitor

DAY = dt.date


def days(n, start=DAY(2024, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def plainly(orders, bars, direction, strict):
    """[(id, matched day, value)] by looking at every bar."""
    out = []
    for i, s, d in orders:
        hit = None
        for symbol, day, v in bars:
            if symbol == s and d is not None:
                ok = (day < d if strict else day <= d) if direction == "backward" else (day > d if strict else day >= d)
                if ok and (hit is None or (day > hit[0] if direction == "backward" else day < hit[0])):
                    hit = (day, v)
        out.append((i, *(hit or (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_lookups_match_loops(spark, direction, strict):
    r = random.Random(3)
    calendar = days(400)
    bars = [(s, d, r.random()) for s in "AB" for d in calendar if r.random() < 0.2] + [("C", calendar[200], 1.0)]
    orders = [(i, r.choice("AAAAABCX"), r.choice([*calendar, None])) for i in range(400)]
    left = spark.createDataFrame(orders, "id int, symbol string, at date")
    right = spark.createDataFrame(bars, "symbol string, day date, v double")
    got = asof.asof_lookup(left, right, by="symbol", left_on="at", right_on="day", values=["v"], direction=direction, strict=strict)
    assert sorted(((x.id, x.day, x.v) for x in got.collect()), key=repr) == plainly(orders, bars, direction, strict)


def test_a_hot_symbol_is_looked_up_once_per_day(spark):
    """However many orders a symbol has, windows only see its distinct days and bars."""
    orders = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 9, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 50)).alias("symbol"),
                                        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("at"))
    bars = orders.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(0), F.lit(69))).alias("n"))
    bars = bars.select("symbol", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("day"), F.col("n").cast("double").alias("v"))
    out = asof.asof_lookup(orders, bars, by="symbol", left_on="at", right_on="day", values=["v"], direction="forward", strict=True)
    assert out.filter("day = date_add(at, 1)").count() == 20_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    seen = orders.select("symbol", "at").distinct().groupBy("symbol").count().agg(F.max("count")).first()[0]
    assert seen == 54  # what a window of the lookup can hold of the hot symbol beside its bars


def book(spark, rows):
    cols = "order_id string, symbol string, fill_date date, target_exit_date date, entry_price double"
    df = spark.createDataFrame(rows, cols)
    return ledger.normalize_ledger(df.withColumns({
        "account_id": F.lit("a"), "status": F.lit("open"), "sector": F.lit(""), "score": F.lit(1.0), "shares": F.lit(10.0), "planned_date": F.col("fill_date"),
        "entry_value": F.col("entry_price") * 10, "entry_cost": F.lit(0.0)}))


def test_positions_read_their_holding_period_only(spark, monkeypatch):
    monkeypatch.setattr(ledger, "BAR_BLOCK", 4)
    r = random.Random(5)
    calendar = days(300)
    prices = [(d, s, 100.0 + r.gauss(0, 8)) for s in "AB" for d in calendar if d.weekday() < 5]
    panel = spark.createDataFrame(prices, "date date, symbol string, adj_close double")
    rows = []
    for i in range(200):
        f = r.choice(calendar)
        rows.append((f"o{i}", r.choice("AAAB"), f, r.choice([f + dt.timedelta(days=r.randrange(0, 40)), calendar[-1] + dt.timedelta(days=9), None]), 100.0))
    held = book(spark, rows)
    cfg = ledger.LedgerConfig(exit_rules=ledger.ExitRules(stop_loss_pct=-0.12))
    got = {}
    for x in ledger.position_days(held, panel, cfg).select("order_id", "day", "high_close").collect():
        got.setdefault(x.order_id, []).append((x.day, x.high_close))
    for order, symbol, fill, target, _ in rows:
        after = sorted((d, c) for d, s, c in prices if s == symbol and d >= fill)
        due = [i for i, (d, _) in enumerate(after) if target is not None and d >= target]
        want = after[: due[0] + 1] if due else after
        assert sorted(got.get(order, [])) == [(d, max(c for _, c in want[: i + 1])) for i, (d, c) in enumerate(want)]
    out = {x.order_id: x for x in ledger.reconcile_exits(held, panel, cfg).collect()}
    for order, symbol, fill, target, _ in rows:
        exit_ = None
        for d, c in sorted((d, c) for d, s, c in prices if s == symbol and d >= fill):
            if c / 100 - 1 <= cfg.exit_rules.stop_loss_pct:
                exit_ = (d, "stop_loss")
            elif target is not None and d >= target:
                exit_ = (d, "horizon")
            if exit_:
                break
        assert (out[order].exit_date, out[order].exit_reason) == (exit_ or (None, "")), order


def test_highs_and_dividends_since_the_fill(spark):
    calendar = days(30)
    prices = spark.createDataFrame([(d, "A", 10.0 + i % 7, 10.0 + i % 5) for i, d in enumerate(calendar)], "date date, symbol string, high double, adj_close double")
    held = book(spark, [("o1", "a", calendar[25], None, 10.0), ("o2", "A", calendar[0], None, 10.0), ("o3", "A", calendar[29] + dt.timedelta(days=5), None, 10.0), ("o4", "Z", calendar[0], None, 10.0)])
    got = {r.order_id: r.daily_high for r in monitor.daily_highs(held, prices).collect()}
    assert got == {"o1": max(10.0 + i % 7 for i in range(25, 30)), "o2": 16.0}
    events = spark.createDataFrame([("A", calendar[3], 0.5), ("A", calendar[3], 0.25), ("A", calendar[27], 1.0)], "symbol string, ex_date date, dividend_per_share double")
    upper = held.withColumn("symbol", F.upper("symbol"))
    paid = {r.order_id: r.dividends for r in ledger.reconcile_dividends(upper, prices, ledger.LedgerConfig(), events).collect()}
    assert paid == {"o1": 10.0, "o2": 17.5, "o3": 0.0, "o4": 0.0}
