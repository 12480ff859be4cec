"""Cross-sections against pandas, also when one group and one value dominate, and plans without whole groups in a task."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelspark.functions import crosssection as cs


def skewed(spark):
    rng = np.random.default_rng(1)
    n = 600
    pdf = pd.DataFrame({
        "date": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)),
        "symbol": [f"S{i:04d}" for i in range(n)],
        # one value holds a third of the rows
        "x": np.where(rng.random(n) < 0.33, 1.0, np.round(rng.normal(size=n), 2)),
    })
    pdf["y"] = -pdf["x"] * 1e-7
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    return pdf, df


def test_percent_ranks_match_pandas(spark):
    pdf, df = skewed(spark)
    got = cs.with_percent_ranks(df, ["date"], {"r": ("x", True), "s": ("x", False), "t": ("y", True)}).toPandas().set_index("symbol").loc[pdf["symbol"]]
    groups = pdf.groupby("date")
    for name, want in (("r", groups["x"].rank(pct=True)), ("s", groups["x"].rank(pct=True, ascending=False)), ("t", groups["y"].rank(pct=True))):
        assert np.allclose(got[name].to_numpy(float), want.to_numpy(), equal_nan=True)


def test_row_index_matches_pandas(spark):
    pdf, df = skewed(spark)
    got = cs.with_row_index(df, ["date"], [F.col("x").desc_nulls_last(), "symbol"], "i").toPandas().set_index("symbol")["i"]
    ordered = pdf.sort_values(["x", "symbol"], ascending=[False, True], na_position="last")
    want = ordered.groupby("date").cumcount() + 1
    assert (got.loc[ordered["symbol"]].to_numpy() == want.to_numpy()).all()


def test_quantiles_match_pandas(spark):
    pdf, df = skewed(spark)
    want = pdf.groupby("date")["x"].quantile([0.1, 0.5, 0.9]).unstack()
    got = cs.group_quantiles(df, ["date"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).toPandas().set_index("date").loc[want.index]
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_bucket_equals_a_quantile_cut(spark):
    pdf, df = skewed(spark)
    got = cs.with_quantile_bucket(df.withColumn("k", F.lit(1)), ["k"], "x", "b", 10).toPandas()
    ranked = got.sort_values(["x", "symbol"]).reset_index(drop=True)
    want = pd.qcut(ranked.index + 1, 10, labels=False) + 1
    assert (ranked["b"].to_numpy() == want).all()


def test_no_window_or_percentile_over_a_whole_group(spark):
    _, df = skewed(spark)
    for out in (cs.with_percent_ranks(df, ["date"], {"r": ("x", True)}), cs.group_quantiles(df, ["date"], "x", {"q": 0.5})):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan
        # windows run over sums per slice, or inside a slice
        assert all("__slice" in line for line in plan.split("\n") if line.strip(" :+-").startswith("Window"))


def test_small_groups_by_windows_and_large_ones_by_slices(spark):
    pdf, df = skewed(spark)
    ranks = {"r": ("x", True), "s": ("x", False), "t": ("y", True)}
    want = cs.with_percent_ranks(df, ["date"], ranks, flat_value=0.5).toPandas().set_index("symbol").sort_index()
    for whole, packed in ((100, False), (1000, False), (100, True), (1000, True)):  # the hot date is over the first bound only
        out = cs.with_percent_ranks(df, ["date"], ranks, flat_value=0.5, stats={"m": F.avg("y")}, whole=whole, packed=packed)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("__slice" in plan) == (whole == 100)
        got = out.toPandas().set_index("symbol").sort_index()
        assert list(got.columns) == [*want.columns, "m"]
        for name in ranks:
            assert np.allclose(got[name].to_numpy(float), want[name].to_numpy(float), equal_nan=True)
        assert np.allclose(got["m"].to_numpy(), pdf.set_index("symbol").sort_index().groupby("date")["y"].transform("mean").to_numpy())


def test_flat_null_and_empty_groups_by_windows(spark):
    rows = [("a", "1", 0.0), ("a", "2", -0.0), ("b", "1", None), (None, "1", 1.0), (None, "2", 2.0)]
    df = spark.createDataFrame(rows, "date string, symbol string, x double")
    for whole, packed in ((0, False), (1, False), (10, False), (1, True), (10, True)):
        out = cs.with_percent_ranks(df, ["date"], {"p": ("x", True), "q": ("x", False)}, flat_value=0.5, whole=whole, packed=packed, stats={"n": F.count("*")})
        rows = out.collect()
        assert {(r.date, r.n) for r in rows} == {("a", 2), ("b", 1), (None, 2)} and len(rows) == 5
        got = {(r.date, r.symbol): (r.p, r.q) for r in rows}
        assert got == {("a", "1"): (0.5, 0.5), ("a", "2"): (0.5, 0.5), ("b", "1"): (None, None), (None, "1"): (0.5, 1.0), (None, "2"): (1.0, 0.5)}
