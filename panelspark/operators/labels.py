"""Forward labels: what a row could not know on its own date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import change, ratio
from panelspark.functions.windows import lead


def forward_return(df: DataFrame, horizon: int, price: str = "adj_close", out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"fwd_{horizon}d_return", change(lead(price, horizon), price))


def executable_forward_return(df: DataFrame, horizon: int, price: str = "adj_close", out: str | None = None) -> DataFrame:
    """Entry at the next adjusted open, exit at the close ``horizon`` rows later."""
    opened = F.col("open") * ratio(price, "close")
    return df.withColumn(out or f"fwd_{horizon}d_exec_return", change(lead(price, horizon), lead(opened, 1)))


def benchmark_forward_returns(benchmark: DataFrame, horizon: int, price: str = "adj_close") -> DataFrame:
    """Date-keyed forward returns of the benchmark, plain and executable."""
    order = Window.orderBy("date")
    later = F.lead(price, horizon).over(order)
    cols = [change(later, price).alias(f"__mkt_{horizon}")]
    if {"open", "close"} <= set(benchmark.columns):
        opened = F.col("open") * ratio(price, "close")
        cols.append(change(later, F.lead(opened, 1).over(order)).alias(f"__mkt_exec_{horizon}"))
    return benchmark.select("date", *cols)


def forward_labels(
    df: DataFrame, benchmark: DataFrame, horizons=(5,), price: str = "adj_close"
) -> DataFrame:
    """Four labels per horizon, joined to the benchmark by date rather than by row position."""
    for h in horizons:
        df = executable_forward_return(forward_return(df, h, price), h, price)
    for h in horizons:
        df = df.join(F.broadcast(benchmark_forward_returns(benchmark, h, price)), "date", "left")
        cols = {f"fwd_{h}d_excess_return": F.col(f"fwd_{h}d_return") - F.col(f"__mkt_{h}")}
        if f"__mkt_exec_{h}" in df.columns:
            cols[f"fwd_{h}d_exec_excess_return"] = (
                F.col(f"fwd_{h}d_exec_return") - F.col(f"__mkt_exec_{h}")
            )
        df = df.withColumns(cols).drop(f"__mkt_{h}", f"__mkt_exec_{h}")
    return df
