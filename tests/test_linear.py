"""Linear models against small exact versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import linear, models


def panel(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.01] + [0.0, 1e4, 3.0]
    x[:, 2] += 1e-6 * x[:, 1]
    y = 0.3 * x[:, 0] - 0.02 * x[:, 1] + 5 * x[:, 2] + rng.normal(size=n) * 0.5
    rows = [(f"S{i % 9}", int(i // 9), *map(float, r), 7.0, float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "symbol string, day int, a double, b double, c double, flat double, target double")
    df = df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day") * 12)).withColumn("fwd_5d_return", F.col("target"))
    return df.withColumn("c", F.when((F.col("day") % 17 != 3) | (F.col("symbol") != "S1"), F.col("c")))


def solved(x, y, alpha):
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda new: (new - x.mean(axis=0)) / x.std(axis=0) @ w + y.mean()


def test_all_trials_of_one_pass_equal_their_own_solutions(spark):
    df = panel(spark)
    cfg = models.ModelConfig(target="target", outcome="target", benchmark_score="a", first_validation_start="2021-01-01", validation_months=6, purge_days=5, embargo_days=20)
    trials = [(("a", "b"), 1.0), (("a", "b", "c"), 1.0), (("a", "b", "c"), 300.0), (("b", "flat"), 5.0)]
    got = models.ridge_predictions(df, trials, cfg).toPandas()
    pdf = df.toPandas()
    for number, (features, alpha) in enumerate(trials):
        use = [c for c in features if c != "flat"]
        ok = pdf.dropna(subset=use)
        folds = models.walk_forward_folds(models.model_rows(df, cfg, features), first_train_start=cfg.first_train_start, first_validation_start=cfg.first_validation_start,
                                          validation_months=6, purge_days=5, embargo_days=20)
        assert len(folds) > 2 and folds[-1].embargoed
        for fold in folds:
            day = ok["date"].astype(str)
            train = (day >= fold.train_start) & (day <= fold.train_end)
            for after, upto in fold.embargoed:
                train &= ~((day > after) & (day <= upto))
            valid = ok[(day >= fold.validation_start) & (day <= fold.validation_end)]
            want = solved(ok.loc[train, use].to_numpy(), ok.loc[train, "target"].to_numpy(), alpha)(valid[use].to_numpy())
            mine = got[(got.trial == number) & (got.split_id == fold.split_id)].set_index(["date", "symbol"])["prediction"]
            assert len(mine) == len(valid)
            assert np.allclose(mine.loc[list(zip(valid["date"], valid["symbol"]))].to_numpy(), want, atol=1e-9, rtol=1e-9)


def test_moments_equal_the_estimator(spark):
    df = panel(spark).dropna()
    cfg = models.ModelConfig(target="target", outcome="target", alpha=40.0)
    old = models.fit(df, cfg, ["a", "b", "c"]).transform(df).select("prediction").toPandas()["prediction"]
    fold = models.Fold(1, "0001-01-01", "9998-12-31", "9999-01-01", "9999-01-01")
    moments = linear.training_moments(df, {"": ("a", "b", "c")}, {"": [fold]}, "target")["", 1]
    new = linear.ridge(moments, ("a", "b", "c"), 40.0).transform(df).select("prediction").toPandas()["prediction"]
    assert np.allclose(old, new, atol=1e-6)


def test_elastic_net_against_coordinate_descent(spark):
    df = panel(spark).dropna()
    pdf = df.toPandas()
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["target"].to_numpy()
    z, n = (x - x.mean(axis=0)) / x.std(axis=0), len(y)
    for alpha, ratio in ((0.05, 0.5), (0.2, 0.9), (0.01, 0.0)):
        w = np.zeros(3)
        for _ in range(3000):
            for j in range(3):
                rest = y - y.mean() - z @ w + z[:, j] * w[j]
                rho = z[:, j] @ rest / n
                w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0.0) / (1 + alpha * (1 - ratio))
        got = models.fit(df, models.ModelConfig(target="target", model_type="elasticnet", alpha=alpha, l1_ratio=ratio), ["a", "b", "c"]).transform(df).toPandas()
        assert np.allclose(got.sort_values(["date", "symbol"])["prediction"], (pdf.assign(p=z @ w + y.mean())).sort_values(["date", "symbol"])["p"], atol=2e-4), (alpha, ratio)


def test_a_saved_linear_model_comes_back(spark, tmp_path):
    fit = linear.LinearFit(("b", "a"), 0.5, np.array([2.0, -1.0]), np.array([1.0, 3.0]))
    fit.save(spark, str(tmp_path / "m"))
    again = linear.LinearFit.load(spark, str(tmp_path / "m"))
    assert again.features == fit.features and again.intercept == 0.5 and again.importances() == [("b", 2.0), ("a", 3.0)]
    assert again.transform(spark.createDataFrame([(1.0, 2.0)], "a double, b double")).first().prediction == pytest.approx(3.5)
