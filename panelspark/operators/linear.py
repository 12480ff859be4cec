"""Ridge regressions of all folds, penalties and feature sets from one aggregation of the data.

Every training window is a union of pieces of the calendar. One pass sums counts, values and products per piece; the moments of a
fold are sums over its pieces, and each penalty and feature set is a small linear system solved from them. Predictions of all
trials come from one further pass over the validation rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

#: Rows whose means shift the sums, so that products do not cancel; any values near the data's own do.
SHIFT_ROWS = 1_000


@dataclass(frozen=True)
class Moments:
    """Count, means and centred co-moments of features and, last, the target of one training window."""

    n: float
    mean: np.ndarray
    co: np.ndarray


@dataclass(frozen=True)
class LinearFit:
    """A linear model in the features' own units, and their sample deviations in training."""

    features: tuple[str, ...]
    intercept: float
    coefficients: np.ndarray
    deviations: np.ndarray

    def prediction(self) -> Column:
        return sum((F.lit(float(b)) * F.col(f"`{c}`") for b, c in zip(self.coefficients, self.features)), F.lit(float(self.intercept)))

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", self.prediction())

    def save(self, spark, path: str) -> None:
        """Write the model as a small table, one row per feature."""
        lines = [(i, c, float(b), float(s), self.intercept) for i, (c, b, s) in enumerate(zip(self.features, self.coefficients, self.deviations))]
        spark.createDataFrame(lines, "at int, feature string, coefficient double, deviation double, intercept double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> LinearFit:
        lines = spark.read.parquet(path).orderBy("at").collect()  # one row per feature
        return cls(tuple(r.feature for r in lines), lines[0].intercept, np.array([r.coefficient for r in lines]), np.array([r.deviation for r in lines]))

    def importances(self) -> list[tuple[str, float]]:
        return [(c, float(abs(b) * s)) for c, b, s in zip(self.features, self.coefficients, self.deviations)]


def complete(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"`{c}`").isNotNull()
    return out


def _spans(fold) -> list[tuple[date, date]]:
    """Training window of a fold and the embargoed ones in it, each [first day, day after the last)."""
    day, one = date.fromisoformat, timedelta(days=1)
    return [(day(fold.train_start), day(fold.train_end) + one), *((day(a) + one, day(b) + one) for a, b in fold.embargoed)]


def _trains(first_day: date, fold) -> bool:
    """Whether a piece of the calendar that begins on ``first_day`` is in the fold's training rows."""
    kept, *gone = _spans(fold)
    return kept[0] <= first_day < kept[1] and not any(a <= first_day < b for a, b in gone)


def training_moments(rows: DataFrame, sets: dict[str, tuple], folds: dict[str, list], target: str, also=(), date_column: str = "date") -> dict[tuple[str, int], Moments]:
    """Moments of every (feature set, fold) from one aggregation over ``rows``.

    A set uses the rows without nulls in its features, the target and the columns ``also``. What comes to the driver has one row per
    piece of the calendar: at most twice the number of folds, of (features of all sets)^2 / 2 numbers each.
    """
    columns = list(dict.fromkeys([*(c for s in sets.values() for c in s), target]))
    near = rows.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).limit(SHIFT_ROWS).agg(*(F.avg(F.col(f"`{c}`")).alias(c) for c in columns)).first()
    shift = {c: float(near[c] or 0.0) for c in columns}
    edges = sorted({d for some in folds.values() for f in some for span in _spans(f) for d in span})
    d = F.col(date_column).cast("date")
    piece = sum((F.when(d >= F.lit(str(e)).cast("date"), 1).otherwise(0) for e in edges), F.lit(0))
    z = {c: F.col(f"`{c}`").cast("double") - F.lit(shift[c]) for c in columns}
    sums = []
    for k, (name, features) in enumerate(sets.items()):
        ok, members = complete([*features, target, *also]), [*features, target]
        sums.append(F.count_if(ok).cast("double").alias(f"n{k}"))
        for i, a in enumerate(members):
            sums.append(F.coalesce(F.sum(F.when(ok, z[a])), F.lit(0.0)).alias(f"s{k}_{i}"))
            sums += [F.coalesce(F.sum(F.when(ok, z[a] * z[b])), F.lit(0.0)).alias(f"p{k}_{i}_{j}") for j, b in enumerate(members) if j <= i]
    table = {r["piece"]: r for r in rows.groupBy(piece.alias("piece")).agg(*sums).toLocalIterator()}
    pieces = list(table)
    out = {}
    for k, (name, features) in enumerate(sets.items()):
        m = len(features) + 1
        at = np.array([shift[c] for c in (*features, target)])
        n = np.array([table[p][f"n{k}"] for p in pieces])
        s = np.array([[table[p][f"s{k}_{i}"] for i in range(m)] for p in pieces]).reshape(-1, m)
        q = np.array([[[table[p][f"p{k}_{max(i, j)}_{min(i, j)}"] for j in range(m)] for i in range(m)] for p in pieces]).reshape(-1, m, m)
        for fold in folds[name]:
            inside = [i for i, p in enumerate(pieces) if p and _trains(edges[p - 1], fold)]  # piece p begins at edge p - 1
            total, sums_, products = n[inside].sum(), s[inside].sum(axis=0), q[inside].sum(axis=0)
            mean = sums_ / total if total else sums_
            out[name, fold.split_id] = Moments(float(total), mean + at, products - total * np.outer(mean, mean))
    return out


def ridge(moments: Moments, features, alpha: float) -> LinearFit:
    """Ridge with the penalty on features of population deviation 1; features that do not vary get no weight."""
    p = len(features)
    co, n = moments.co, max(moments.n, 1.0)
    square = np.diag(co)[:p]
    varies = square > 1e-12 * (square + n * np.square(moments.mean[:p])) * 1e-4
    scale = np.where(varies, np.sqrt(np.where(varies, square, 1.0) / n), 1.0)
    weights = np.zeros(p)
    if varies.any():
        v = np.flatnonzero(varies)
        system = co[np.ix_(v, v)] / np.outer(scale[v], scale[v]) + alpha * np.eye(len(v))
        weights[v] = np.linalg.lstsq(system, co[v, p] / scale[v], rcond=None)[0] / scale[v]
    deviations = np.where(varies, scale * np.sqrt(n / max(n - 1, 1.0)), 0.0)
    return LinearFit(tuple(features), float(moments.mean[p] - weights @ moments.mean[:p]), weights, deviations)


def split_of(folds, date_column: str = "date") -> Column:
    """The fold whose validation window holds the row; validation windows do not overlap."""
    d = F.col(date_column).cast("date")
    out = F.lit(None).cast("int")
    for f in folds:
        out = F.when(d.between(F.lit(f.validation_start).cast("date"), F.lit(f.validation_end).cast("date")), F.lit(int(f.split_id))).otherwise(out)
    return out


def predictions(rows: DataFrame, sets: dict[str, tuple], folds: dict[str, list], fits: dict[tuple[int, str, int], LinearFit], keep, also=()) -> DataFrame:
    """(trial, split_id, *keep, prediction) of every trial's validation rows; ``fits`` has (trial, set, split) keys.

    One pass: each row meets the coefficients of its fold's trials, a table bounded by trials times folds.
    """
    names = list(sets)
    features = list(dict.fromkeys(c for s in sets.values() for c in s))
    lines = [(trial, names.index(name), split, fit.intercept, [float(dict(zip(fit.features, fit.coefficients)).get(c, 0.0)) for c in features]) for (trial, name, split), fit in fits.items()]
    table = rows.sparkSession.createDataFrame(lines, "trial int, __set int, split_id int, __b0 double, __b array<double>")
    parts = F.array(*(F.struct(F.lit(k).alias("__set"), split_of(folds[name]).alias("split_id"), complete([*sets[name], *also]).alias("ok")) for k, name in enumerate(names)))
    each = rows.select(*keep, *(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"__x_{c}") for c in features), F.explode(F.filter(parts, lambda x: x["ok"] & x["split_id"].isNotNull())).alias("__at"))
    each = each.select("*", "__at.__set", "__at.split_id").drop("__at")
    value = sum((F.col("__b")[i] * F.col(f"`__x_{c}`") for i, c in enumerate(features)), F.col("__b0"))
    return each.join(F.broadcast(table), ["__set", "split_id"]).select("trial", "split_id", *keep, value.alias("prediction"))


def days_of(rows: DataFrame, sets: dict[str, tuple], needed, date_column: str = "date") -> DataFrame:
    """Usable rows of every set per day (columns n0, n1, ...): one row per calendar day."""
    counts = [F.count_if(complete([*features, *needed])).alias(f"n{k}") for k, features in enumerate(sets.values())]
    return cut_lineage(rows.groupBy(F.col(date_column).cast("date").alias("date")).agg(*counts))
