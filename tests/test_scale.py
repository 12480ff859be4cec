"""Queries that must do no more than their result needs, with the results of the plain way."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import crosssection as cs
from panelspark.operators import discovery, evaluation, features, ledger, models
from panelspark.plans import queries_evaluation as q
from panelspark.plans.fixtures import Inputs

DAY = "1999-06-15"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


# --- F6 ---------------------------------------------------------------------------------------------


def test_trees_grow_in_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    seen = []

    class Pipeline:
        def fit(self, train):
            seen.append((train.rdd.getNumPartitions(), train.count()))

    monkeypatch.setattr(models, "build_pipeline", lambda *a: Pipeline())
    df = spark.range(1000, numPartitions=64).select(F.rand(1).alias("x"), F.rand(2).alias("target"))
    models.fit(df, models.ModelConfig(target="target", model_type="random_forest"), ["x"])
    monkeypatch.setattr(models, "TREE_ROWS", 300)
    models.fit(df, models.ModelConfig(target="target", model_type="random_forest"), ["x"])
    assert seen == [(1, 1000), (4, 1000)]


# --- F16, F17, F18, F22 ------------------------------------------------------------------------------


def test_exclusions_need_no_ranks_and_no_scores(spark, monkeypatch):
    i = Inputs(spark, "/root/testdata/sf0.01")
    names = ["date", "symbol", "name", "sector", "industry", "exclusion_reasons"]
    _, day = discovery.filter_candidates(q.discovery_frame(i, [DAY]), q.DISCOVERY, q.watched(i))
    _, every = discovery.filter_candidates(q.discovery_frame(i), q.DISCOVERY, q.watched(i))
    every = every.groupBy("exclusion_reasons").agg(F.count("*").alias("rows"))
    want = rows(day, *names), rows(every, "exclusion_reasons", "rows")

    def stop(*a, **kw):
        raise AssertionError("scores or ranks were made")

    monkeypatch.setattr(discovery, "cut_lineage", stop)
    monkeypatch.setattr(features, "with_percent_ranks", stop)
    assert want[0] and rows(q.discovery_exclusions(i), *names) == want[0]
    assert rows(q.discovery_exclusion_reasons_all_dates(i), "exclusion_reasons", "rows") == want[1]


def test_one_days_features_have_no_long_frames(spark):
    i = Inputs(spark, "/root/testdata/sf0.01")
    one = q.discovery_frame(i, [DAY])
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    back = [int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+)", plan)]
    assert back and max(back) <= 60
    names = ["symbol", *(n for n, t in one.dtypes if t == "double")]
    got = one.select(names).toPandas().set_index("symbol").sort_index()
    want = q.discovery_frame(i).filter(F.col("date") == F.lit(DAY).cast("date")).select(names).toPandas().set_index("symbol").sort_index()
    assert len(got) and list(got.index) == list(want.index)
    for name in names[1:]:
        assert np.allclose(got[name].to_numpy(float), want[name].to_numpy(float), rtol=1e-9, atol=1e-12, equal_nan=True), name


# --- F24, F25 ----------------------------------------------------------------------------------------


def test_marks_read_prices_and_ledger_once(spark, tmp_path):
    days = [str(d.date()) for d in pd.bdate_range("2020-01-01", periods=60)]
    prices = [(s, d, 10.0 + k % 7 + n) for n, s in enumerate("abc") for k, d in enumerate(days[: 60 - n])]
    spark.createDataFrame(prices, "symbol string, date string, adj_close double").withColumn("date", F.col("date").cast("date")).write.parquet(f"{tmp_path}/p")
    lines = [(f"{s}{k}", s, status, days[k] if status == "open" else None, days[k + 20]) for s in "abcd" for k, status in ((3, "open"), (30, "open"), (35, "planned"), (1, "closed"))]
    book = spark.createDataFrame(lines, "order_id string, symbol string, status string, fill_date string, target_exit_date string").withColumns({
        "account_id": F.lit("A"), "sector": F.lit("x"), "shares": F.lit(1.0), "entry_price": F.lit(10.0), "entry_value": F.lit(10.0),
        "entry_cost": F.lit(0.0), "planned_date": F.col("fill_date"), "score": F.lit(1.0)})
    book.write.parquet(f"{tmp_path}/b")
    frame = spark.read.parquet(f"{tmp_path}/p")
    scores = frame.select("symbol", "date", F.col("adj_close").alias("score"))
    out = ledger.mark_positions(spark.read.parquet(f"{tmp_path}/b"), frame, ledger.LedgerConfig(), scores=scores)
    assert "parquet" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.order_id.lower(): r for r in out.collect()}
    assert set(got) == {x[0] for x in lines if x[2] != "closed"}
    for order, symbol, status, fill, _ in lines:
        if status == "closed":
            continue
        mine = sorted((d, x) for s, d, x in prices if s == symbol)
        r = got[order]
        if not mine:
            assert r.latest_price is None
            continue
        assert (str(r.latest_price_date), r.latest_price) == mine[-1]
        if status == "open":
            assert r.highest_close_since_entry == max(x for d, x in mine if d >= fill)
            assert r.current_score == mine[-1][1]


# --- F30, F32, F33 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("whole", [0, cs.WHOLE])
def test_ends_match_pandas_and_store_no_whole_frame(spark, monkeypatch, whole):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({
        "date": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)), "symbol": [f"S{i:05d}" for i in range(n)],
        "x": np.where(rng.random(n) < 0.3, 1.0, np.round(rng.normal(size=n), 3))})
    pdf = pd.concat([pdf, pd.DataFrame({"date": ["one", "two", "two"], "symbol": ["a", "b", "a"], "x": [0.0, -0.0, 0.0]})], ignore_index=True)
    pdf.loc[pdf["date"] == "c", "x"] = 2.5  # one value only
    df = spark.createDataFrame(pdf).cache()
    stored, cut = [], cs.cut_lineage

    def counted(frame):
        out = cut(frame)
        stored.append(out.count())
        return out

    monkeypatch.setattr(cs, "cut_lineage", counted)
    monkeypatch.setattr(cs, "WHOLE", whole)
    ten = F.greatest(F.lit(1), F.floor(F.col("__n") * 0.1).cast("int"))
    out = cs.with_ends(df, ["date"], "x", ten, ten, stored=True)
    assert set(out.columns) == {"date", "symbol", "x", "__n", "__low", "__high"}
    got = out.collect()
    for date, some in pdf.groupby("date"):
        k = max(1, len(some) // 10)
        low = some.assign(x=some["x"] + 0.0).sort_values(["x", "symbol"]).head(k)["symbol"]
        high = some.assign(x=-some["x"] + 0.0).sort_values(["x", "symbol"]).head(k)["symbol"]
        assert {r.symbol for r in got if r.date == date and r["__low"]} == set(low)
        assert {r.symbol for r in got if r.date == date and r["__high"]} == set(high)
        assert {r["__n"] for r in got if r.date == date} == {len(some)}
    assert max(stored) < 0.6 * len(pdf)


def test_an_audit_makes_only_the_tables_asked_for(spark, monkeypatch):
    days = pd.bdate_range("1997-01-01", "2000-12-31", freq="W")
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(d.date(), f"S{k}", float(x), float(y)) for d in days for k, (x, y) in enumerate(rng.normal(size=(12, 2)))], columns=["date", "symbol", "x1", "r"])
    frame = spark.createDataFrame(pdf).select("date", "symbol", "x1", F.col("x1").alias("score"), *(F.col("r").alias(c) for c in ("target", "forward_return", "fwd_5d_return", "fwd_5d_excess_return")))
    sets, specs = {"one": ("x1",)}, {"ridge": {"model_type": "ridge", "alpha": 50.0}}
    board = spark.createDataFrame([("ridge_one_5d", 5, "one", "ridge", "close_excess", 1.0)], "experiment string, horizon int, feature_set string, model string, target_kind string, risk_backtest_sharpe double")
    made, summarize = [], models.summarize_splits
    monkeypatch.setattr(models, "summarize_splits", lambda *a, **kw: made.append("splits") or summarize(*a, **kw))
    monkeypatch.setattr(models, "positions", lambda *a, **kw: made.append("symbols") or evaluation.positions(*a, **kw))
    audit = models.audit_experiment(frame, board, "ridge_one_5d", sets=sets, specs=specs, config=q.MODEL)
    assert audit["monthly"].count() == 36 and not made
    assert set(audit) == {"experiment", "predictions", "splits", "daily", "monthly", "symbols", "importance"}
    assert audit["splits"].count() == 3 and audit["symbols"].count() == 12 and made == ["splits", "symbols"]


# --- F31 ---------------------------------------------------------------------------------------------


def test_moving_averages_sort_a_symbol_twice(spark):
    df = spark.createDataFrame([("A", 1, 2.0)], "symbol string, date int, adj_close double").repartition(4)
    plan = features.macd(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan.split("== Initial Plan ==")[0])) == 2
