"""As-of joins without range joins: one union and one window for panels, bucketed lookups where a key may hold any number of rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by,
    left_on: str,
    right_on: str,
    values,
    direction: str = "backward",
    strict: bool = False,
) -> DataFrame:
    """Attach to each left row the nearest right row of the same key.

    ``backward`` takes the latest right row at or before the left time, ``forward`` the earliest at
    or after it; ``strict`` excludes equal times. Right rows must be unique per (key, time). Unmatched
    rows get nulls, and a left row is never dropped or repeated.

    For panels: keys with one row per date on either side, so that a key's rows are bounded by the calendar. Where a key may hold
    any share of the left rows (orders of all accounts) or any number of right ones (ticks), use :func:`asof_lookup`. Right rows
    are dealt by key, so left rows that lie by key already stay where they are.
    """
    by = [by] if isinstance(by, str) else list(by)
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    backward = direction == "backward"
    packed = F.struct(F.col(right_on).alias(right_on), *[F.col(v).alias(v) for v in values])
    # equal times: the right row must sort first unless the match is strict
    side_right, side_left = (1, 0) if strict else (0, 1)
    lefts = left.withColumns({"__t": F.col(left_on).cast("timestamp_ntz"), "__side": F.lit(side_left)})
    rights = right.filter(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).cast("timestamp_ntz").alias("__t"), F.lit(side_right).alias("__side"),
        packed.alias("__right"), F.lit(True).alias("__is_right"),
    ).repartition(*by)
    both = lefts.withColumn("__is_right", F.lit(False)).unionByName(rights, allowMissingColumns=True)
    time = F.col("__t").asc() if backward else F.col("__t").desc()
    frame = (
        Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    )
    matched = both.withColumn("__hit", F.last("__right", ignorenulls=True).over(frame)).filter(~F.col("__is_right"))
    out = matched.drop(*[v for v in [right_on, *values] if v in left.columns and v != left_on])
    keep = [c for c in left.columns if c not in values and (c != right_on or c == left_on)]
    names = {right_on: f"{right_on}_matched"} if right_on == left_on else {}
    return out.select(
        *keep,
        *[
            F.when(F.col(left_on).isNotNull(), F.col("__hit")[v]).alias(names.get(v, v))
            for v in [right_on, *values]
        ],
    )


def asof_lookup(
    left: DataFrame,
    right: DataFrame,
    *,
    by,
    left_on: str,
    right_on: str,
    values,
    direction: str = "backward",
    strict: bool = False,
) -> DataFrame:
    """:func:`asof_join` for keys of any size on either side; null keys and null times match nothing.

    Only the distinct (key, time) pairs of the left are looked up. Both sides are cut into calendar months: within a month a window
    finds the nearest right row, and the last (first) right row of each month is carried over to the following (earlier) months by a
    scan over one row per key and month. The answers are joined back by equality, which adaptive execution splits where one pair
    holds very many left rows.
    """
    by = [by] if isinstance(by, str) else list(by)
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    backward = direction == "backward"
    time, month = F.col("__t"), F.year("__t") * 12 + F.month("__t")
    side_right, side_left = (1, 0) if strict else (0, 1)
    packed = F.struct(F.col(right_on).alias(right_on), *[F.col(v).alias(v) for v in values])
    rights = right.filter(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).cast("timestamp_ntz").alias("__t"), F.lit(side_right).alias("__side"), packed.alias("__right"))
    asked = left.select(*by, F.col(left_on).cast("timestamp_ntz").alias("__t")).filter("__t is not null").distinct()
    points = asked.withColumn("__side", F.lit(side_left)).unionByName(rights, allowMissingColumns=True).withColumn("__month", month)
    # said here and not left to the planner, so that both uses of the points read the same shuffles
    points = points.filter(functools.reduce(operator.and_, [F.col(c).isNotNull() for c in (*by, "__t", "__month")]))
    order = [time.asc() if backward else time.desc(), F.col("__side")]
    inside = Window.partitionBy(*by, "__month").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = points.withColumn("__hit", F.last("__right", ignorenulls=True).over(inside)).filter(F.col("__side") == side_left)
    ends = (F.max_by if backward else F.min_by)("__right", F.when(F.col("__right").isNotNull(), time))
    months = points.groupBy(*by, "__month").agg(ends.alias("__end"))
    earlier = Window.partitionBy(*by).orderBy(F.col("__month").asc() if backward else F.col("__month").desc()).rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(*by, "__month", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    found = met.join(months, [*by, "__month"]).select(*by, "__t", F.coalesce("__hit", "__carried").alias("__hit"))
    out = left.withColumn("__t", F.col(left_on).cast("timestamp_ntz")).join(found, [*by, "__t"], "left")
    keep = [c for c in left.columns if c not in values and (c != right_on or c == left_on)]
    names = {right_on: f"{right_on}_matched"} if right_on == left_on else {}
    return out.select(*keep, *[F.col("__hit")[v].alias(names.get(v, v)) for v in [right_on, *values]])


def latest_per_key(df: DataFrame, key: str = "symbol", time: str = "date", cutoff=None) -> DataFrame:
    """Latest row per key, optionally at or before a cutoff; map-side combined."""
    if cutoff is not None:
        df = df.filter(F.col(time) <= F.lit(str(cutoff)).cast("date"))
    others = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*others), F.col(time)).alias("__row")
    return df.groupBy(key).agg(row).select(key, *[F.col("__row")[c].alias(c) for c in others])


def next_listed_date(dates: DataFrame, listed: DataFrame, strict: bool = False) -> DataFrame:
    """Map each distinct ``date`` to the first ``as_of_date`` at or after it (after it, if strict).

    Both sides hold one row per calendar date, so one ordered pass over them is bounded.
    """
    days = dates.select(F.col("date").cast("date").alias("date")).distinct()
    days = days.select("date", F.lit(None).cast("date").alias("as_of_date"), F.lit(0 if strict else 1).alias("__side"))
    marks = listed.select(F.col("as_of_date").cast("date").alias("as_of_date"))
    marks = marks.select(F.col("as_of_date").alias("date"), "as_of_date", F.lit(1 if strict else 0).alias("__side"))
    order = Window.orderBy(F.desc("date"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("as_of_date", ignorenulls=True).over(order)
    hits = days.unionByName(marks).withColumn("__hit", found).filter("as_of_date is null")
    return hits.select("date", F.col("__hit").alias("as_of_date")).filter("as_of_date is not null")


def latest_rows_at(panel: DataFrame, dates: DataFrame, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """For every ``as_of_date`` the latest row of every symbol at or before it.

    Rows are first reduced, map-side, to the last one per symbol and rebalance period. Gaps are then
    filled by repeating a row over the following period numbers up to the symbol's next row, so there
    is no range join over the panel. Date tables are bounded by the calendar and broadcast.
    """
    numbered = _numbered(dates)
    periods = _periods(panel.select(F.col(date).alias("date")), numbered)
    others = [c for c in panel.columns if c != symbol]
    tagged = panel.withColumn("__d", F.col(date).cast("date")).join(F.broadcast(periods), "__d")
    last = tagged.groupBy(symbol, "__k").agg(
        F.max_by(F.struct(*others), F.col(date)).alias("__row"), F.max("__last").alias("__last")
    )
    upto = F.coalesce(F.lead("__k").over(Window.partitionBy(symbol).orderBy("__k")) - 1, F.col("__last"))
    spread = last.withColumn("__upto", upto).withColumn("__k", F.explode(F.sequence("__k", "__upto")))
    return spread.join(F.broadcast(numbered.drop("__last")), "__k").select(
        "as_of_date", symbol, *[F.col("__row")[c].alias(c) for c in others]
    )


def _numbered(dates: DataFrame) -> DataFrame:
    numbered = dates.select(
        F.col("as_of_date").cast("date").alias("as_of_date"),
        F.row_number().over(Window.orderBy("as_of_date")).alias("__k"),
    )
    return numbered.withColumn("__last", F.max("__k").over(Window.orderBy(F.desc("__k"))))


def _periods(days: DataFrame, numbered: DataFrame) -> DataFrame:
    """The number of the first as-of date at or after each day, and of the last one of all."""
    periods = next_listed_date(days, numbered.select("as_of_date"))
    return periods.join(F.broadcast(numbered), "as_of_date").select(F.col("date").alias("__d"), "__k", "__last")


def mark_latest(panel: DataFrame, dates: DataFrame, days: DataFrame, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """``panel`` with the numbers ``__k`` to ``__upto`` of the as-of dates at which a row is its symbol's latest, null for other rows.

    :func:`spread_latest` of the marked rows is :func:`latest_rows_at` of the panel, whose symbols have one row per day. Rows stay where
    they are, so rows that only others' ranks need can be dropped in between. ``days`` holds at least the panel's days.
    """
    tagged = panel.withColumn("__d", F.col(date).cast("date")).join(F.broadcast(_periods(days, _numbered(dates))), "__d", "left")
    later = F.lead("__k").over(Window.partitionBy(symbol).orderBy("__d"))
    tagged = tagged.withColumn("__next", later)
    latest = F.col("__k").isNotNull() & (F.col("__next").isNull() | (F.col("__next") > F.col("__k")))
    upto = F.when(latest, F.coalesce(F.col("__next") - 1, F.col("__last")))
    return tagged.withColumns({"__upto": upto, "__k": F.when(latest, F.col("__k"))}).drop("__d", "__last", "__next")


def spread_latest(marked: DataFrame, dates: DataFrame, symbol: str = "symbol") -> DataFrame:
    """A row for every as-of date at which a row of :func:`mark_latest` is its symbol's latest."""
    others = [c for c in marked.columns if c not in (symbol, "__k", "__upto")]
    spread = marked.filter("__k is not null").withColumn("__k", F.explode(F.sequence("__k", "__upto")))
    return spread.join(F.broadcast(_numbered(dates).drop("__last")), "__k").select("as_of_date", symbol, *others)
