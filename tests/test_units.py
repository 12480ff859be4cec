"""Hand-made values, stores, streams and models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import calendar
from panelspark.functions.windows import with_ewm
from panelspark.operators import evaluation, ledger, models, portfolio
from panelspark.sources import files, store

DAY = dt.date


def test_long_short_day(spark):
    rows = [("2024-01-02", s, score, r) for s, score, r in (("A", 4.0, 0.10), ("B", 3.0, 0.0), ("C", 2.0, 0.0), ("D", 1.0, -0.06))]
    df = spark.createDataFrame(rows, "date string, symbol string, score double, forward_return double")
    cfg = evaluation.EvaluationConfig(long_fraction=0.25, short_fraction=0.25, max_position_weight=0.25, transaction_cost_bps=20, slippage_bps=20)
    got = evaluation.long_short_returns(df, cfg).first()
    assert (got.gross_return, got.cost, got.net_return) == pytest.approx((0.04, 0.002, 0.038))


def test_business_days_match_numpy(spark):
    days = pd.date_range("2023-12-20", periods=40)
    df = spark.createDataFrame([(d.date(), (d + pd.Timedelta(days=9)).date()) for d in days], "a date, b date")
    got = df.select(calendar.business_days_between("a", "b").alias("n"), calendar.add_business_days("a", F.lit(3)).alias("p")).collect()
    for d, r in zip(days, got):
        assert r.n == len(pd.bdate_range(d, d + pd.Timedelta(days=9))) - 1
        assert r.p == (d + pd.offsets.BDay(3)).date()
    none = df.select(calendar.business_days_between(F.lit(None).cast("date"), "b").alias("n")).first()
    assert none.n == 0


def test_exponential_mean_across_blocks(spark):
    x = np.cumsum(np.random.default_rng(2).normal(size=1300)) + 100
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": np.arange(1300), "x": x}))
    got = with_ewm(df, {"slow": ("x", 26), "fast": ("x", 9)}).orderBy("date").toPandas()
    for name, span in (("slow", 26), ("fast", 9)):
        assert np.allclose(got[name], pd.Series(x).ewm(span=span, adjust=False).mean(), rtol=1e-12)


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2]
    y = x @ [0.5, -0.1, 2.0] + rng.normal(size=400)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(target=y)
    cfg = models.ModelConfig(target="target", alpha=30.0)
    df = spark.createDataFrame(pdf)
    got = models.predict(models.fit(df, cfg, list("abc")), df).toPandas()["prediction"]
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 30.0 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(got, z @ w + y.mean(), atol=1e-6)


def test_water_filling_respects_the_cap(spark):
    df = spark.createDataFrame([("d", s, w) for s, w in (("A", 8.0), ("B", 1.0), ("C", 1.0))], "k string, symbol string, raw double")
    got = {r.symbol: r.weight for r in portfolio.with_capped_weights(df, ["k"], "raw", 0.5).collect()}
    assert got == pytest.approx({"A": 0.5, "B": 0.25, "C": 0.25})


def test_store_upserts_appends_and_models(spark, tmp_path):
    tables = store.TableStore(spark, str(tmp_path / "db"))
    base = spark.createDataFrame([("o1", "planned", "A"), ("o2", "open", "B")], "order_id string, status string, symbol string")
    tables.replace_ledger(base)
    tables.upsert_orders(spark.createDataFrame([("o1", "open", "A"), ("o3", "planned", "C")], base.schema))
    assert {r.order_id: r.status for r in tables.ledger().collect()} == {"o1": "open", "o2": "open", "o3": "planned"}
    assert tables.append_orders(spark.createDataFrame([("o3", "open", "C"), ("o4", "planned", "D")], base.schema)) == 1
    assert tables.open_positions().count() == 2 and tables.order("o4").count() == 1
    tables.append_run(spark.createDataFrame([("r1", "2024-01-01", float("nan"))], "run_id string, local_time string, account_equity double"))
    tables.append_run(spark.createDataFrame([("r2", "2024-01-02", "x")], "run_id string, local_time string, note string"))
    assert [r.run_id for r in tables.history().collect()] == ["r2", "r1"]
    assert tables.history().filter("account_equity is null").count() == 2
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "a double, target double")
    cfg = models.ModelConfig(target="target", alpha=1e-6)
    one = tables.save_model(models.fit(df, cfg, ["a"]), model_type="ridge", features=["a"], config={}, metrics={"s": 1.0})
    two = tables.save_model(models.fit(df, cfg, ["a"]), model_type="ridge", features=["a"], config={}, metrics={"s": 2.0})
    assert tables.best_model("s").first().model_id == two
    assert tables.load_model(one) is not None and tables.delete_model(one) and not tables.delete_model(one)


def test_fill_is_partial_then_final(spark):
    book = spark.createDataFrame([("a", "o1", "planned", "A", DAY(2024, 1, 1), 10.0, 10.0)],
                                 "account_id string, order_id string, status string, symbol string, planned_date date, shares double, requested_shares double")
    prices = spark.createDataFrame([(DAY(2024, 1, d), "A", 10.0, 10.0, 10.0) for d in (1, 2, 3, 4)], "date date, symbol string, open double, close double, adj_close double")
    cfg = ledger.LedgerConfig(fill_pct=0.5)
    first = ledger.reconcile_fills(book, prices, cfg)
    one = first.first()
    assert (one.status, one.filled_shares, one.fill_date) == ("filling", 5.0, DAY(2024, 1, 2))
    two = ledger.reconcile_fills(first, prices, cfg).first()
    assert two.filled_shares == 7.0 and two.entry_value == pytest.approx(70.0) and two.fill_date == DAY(2024, 1, 3)


def test_csv_prices_are_strict(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("date,symbol,open,high,low,close,adj_close,volume\n2024-01-02,spy,1,2,1,2,2,100\n")
    assert files.read_prices(spark, str(path)).first().symbol == "SPY"
    path.write_text("date,symbol,open,high,low,close,adj_close,volume\n2024-01-02,spy,1,2,1,2,,100\n")
    with pytest.raises(Exception):
        files.read_prices(spark, str(path)).collect()


def test_no_cartesian_product_in_the_flagship_plan(spark):
    import __spark_entry__ as entry

    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_recent_rows_give_the_features_of_their_last_day(spark):
    from pyspark.sql import functions as F

    from panelspark.operators import features

    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))
    x = F.abs(F.hash("id", "symbol")) % 1000 + 1.0
    df = spark.range(400).crossJoin(spark.createDataFrame([("a",), ("b",)], "symbol string")).select("symbol", day.alias("date"), x.alias("adj_close"), x.alias("volume"))
    df = df.filter("symbol = 'a' or date > '2020-12-01'")  # b is younger than the longest window
    last = "2020-12-20"
    part = features.recent_rows(df, last, 253)
    assert {r.symbol: r["count"] for r in part.groupBy("symbol").count().collect()} == {"a": 253, "b": 19}
    want, got = (features.discovery_features(t).filter(F.col("date") == last).orderBy("symbol").collect() for t in (df, part))
    assert got == want and got[0].distance_from_52w_high is not None


def test_monitoring_summary_runs_the_funnel_once(monkeypatch):
    from panelspark.plans import queries_evaluation as q

    calls = []
    monkeypatch.setattr(q, "funnel", lambda i: calls.append(i) or {"candidates": "c"})
    monkeypatch.setattr(q, "monitored", lambda i, r=None: r or q.funnel(i))
    monkeypatch.setattr(q.monitoring, "monitoring_summary", lambda universe, eligible, monitored: (eligible, monitored))

    class Nothing:
        def universe(self):
            return None

    assert q.monitoring_summary_query(Nothing()) == ("c", {"candidates": "c"}) and len(calls) == 1
