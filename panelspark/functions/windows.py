"""Row-count rolling statistics over one symbol's history.

A symbol holds at most one row per calendar day (the panel key is unique), so a symbol window is
bounded by the calendar, about 37,000 rows for a century, however many symbols there are. That is
why plain windows partitioned by symbol are safe here while cross-sections need
:mod:`panelspark.functions.crosssection`.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import col


def by_symbol(symbol: str = "symbol", date: str = "date"):
    return Window.partitionBy(symbol).orderBy(date)


def trailing(w: int, symbol: str = "symbol", date: str = "date"):
    return by_symbol(symbol, date).rowsBetween(-(w - 1), 0)


def gated(value, frame, w: int, stat) -> Column:
    """``stat`` over ``frame``, null until the frame holds ``w`` non-null values."""
    x = col(value)
    return F.when(F.count(x).over(frame) == w, stat(x).over(frame))


def rolling(value, w: int, stat, symbol: str = "symbol", date: str = "date", dense: bool = False) -> Column:
    """``stat`` over the last ``w`` rows, null until they hold ``w`` values.

    ``dense`` declares the value free of nulls, so the row position decides and no count is kept.
    """
    if dense:
        full = F.row_number().over(by_symbol(symbol, date)) >= w
        return F.when(full, stat(col(value)).over(trailing(w, symbol, date)))
    return gated(value, trailing(w, symbol, date), w, stat)


def rolling_mean(value, w: int, **kw) -> Column:
    return rolling(value, w, F.avg, **kw)


def rolling_std(value, w: int, **kw) -> Column:
    return rolling(value, w, F.stddev_samp, **kw)


def lag(value, n: int = 1, symbol: str = "symbol", date: str = "date") -> Column:
    return F.lag(col(value), n).over(by_symbol(symbol, date))


def lead(value, n: int = 1, symbol: str = "symbol", date: str = "date") -> Column:
    return F.lead(col(value), n).over(by_symbol(symbol, date))


def compounded(value, order, keys=()) -> Column:
    """Running product of ``1 + value`` (nulls count as 0), for one-row-per-date tables."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.product(F.lit(1.0) + F.coalesce(col(value), F.lit(0.0))).over(frame)


def running_max(value, order, keys=()) -> Column:
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(col(value)).over(frame)

#: Rows per block of the exponential mean. The oldest weight after one block is below double
#: precision for every span up to 27, so a block only needs the end value of the block before it.
EWM_BLOCK = 512


def with_ewm_blocks(df, symbol: str = "symbol", date: str = "date"):
    """Blocks of :data:`EWM_BLOCK` rows ``__b`` and places in them ``__r``, for several calls of :func:`with_ewm`."""
    df = df.withColumn("__j", F.row_number().over(by_symbol(symbol, date)) - 1)
    return df.withColumns({"__b": F.floor(F.col("__j") / EWM_BLOCK), "__r": F.col("__j") % EWM_BLOCK}).drop("__j")


def with_ewm(df, specs: dict[str, tuple[str, int]], symbol: str = "symbol", date: str = "date"):
    """Recursive exponential means ``y = (1-a)*y_prev + a*x`` with ``a = 2/(span+1)``.

    Written as running sums inside fixed blocks plus a carry from the previous block, so the
    recursion stays in window functions: no Python and no array building. ``specs`` maps an output
    name to ``(value column, span)``. Columns of :func:`with_ewm_blocks` are used and kept if the frame has them. A task
    holds its rows once for every order they are sorted in, so blocks and symbols share one.
    """
    numbered = {"__b", "__r"} <= set(df.columns)
    df = df if numbered else with_ewm_blocks(df, symbol, date)
    block = (
        Window.partitionBy(symbol, "__b").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    )
    # by date, named so that the order is that of the blocks
    whole = Window.partitionBy(symbol).orderBy("__b", date)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    start = whole.rowsBetween(Window.unboundedPreceding, 0)
    local, final = {}, {}
    for name, (value, span) in specs.items():
        a = 2.0 / (span + 1.0)
        keep = F.lit(1.0 - a)
        r = F.col("__r").cast("double")
        local[f"__l_{name}"] = F.pow(keep, r) * F.sum(F.col(value) * a * F.pow(keep, -r)).over(block)
        ends = F.when(F.col("__r") == EWM_BLOCK - 1, F.col(f"__l_{name}"))
        carry = F.coalesce(F.last(ends, ignorenulls=True).over(before), F.first(value).over(start))
        final[name] = F.pow(keep, r + 1.0) * carry + F.col(f"__l_{name}")
    df = df.withColumns(local).withColumns(final)
    return df.drop(*([] if numbered else ["__b", "__r"]), *local)
