"""Panel checks and frame normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalar import number, symbol_key
from panelspark.session import require_columns

PRICE_COLUMNS = ("date", "symbol", "open", "high", "low", "close", "adj_close", "volume")
UNIVERSE_COLUMNS = ("symbol", "name", "category", "sector", "industry")


def null_counts(df: DataFrame, columns=PRICE_COLUMNS) -> DataFrame:
    """One row with the null count of every column, in one pass."""
    require_columns(df, columns, "prices")
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def validate_prices(df: DataFrame) -> DataFrame:
    """Fail the job on the first null cell without a separate pass over the data."""
    require_columns(df, PRICE_COLUMNS, "prices")
    message = F.lit("prices contain null values")
    return df.withColumns(
        {c: F.when(F.col(c).isNull(), F.raise_error(message)).otherwise(F.col(c)) for c in PRICE_COLUMNS}
    )


def duplicate_keys(df: DataFrame, keys=("symbol", "date")) -> DataFrame:
    """Keys that occur more than once; empty for a valid panel."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def split_benchmark(prices: DataFrame, benchmark: str = "SPY", *, check: bool = False):
    """Return ``(tradable rows, benchmark rows)``; ``check`` runs the emptiness test at once."""
    is_benchmark = F.upper("symbol") == benchmark.upper()
    series, tradable = prices.filter(is_benchmark), prices.filter(~is_benchmark)
    if check and series.isEmpty():
        raise ValueError(f"no benchmark rows for {benchmark!r}")
    return tradable, series


def normalize_panel(df: DataFrame, *, price: str | None = None) -> DataFrame:
    require_columns(df, ("date", "symbol"), "frame")
    out = df.withColumns({"date": F.col("date").cast("timestamp_ntz"), "symbol": symbol_key("symbol")})
    return out.withColumn(price, number(price)) if price else out


def as_of_date(df: DataFrame, requested=None, date: str = "date") -> DataFrame:
    """One-row table ``as_of_date``: the requested date if present in the panel, else the latest."""
    dates = df.select(F.col(date).cast("date").alias("d"))
    if requested is not None:
        dates = dates.filter(F.col("d") == F.lit(str(requested)).cast("date"))
    table = dates.agg(F.max("d").alias("as_of_date"))
    missing = F.raise_error(F.lit(f"as-of date {requested} is not present"))
    return table.select(F.coalesce("as_of_date", missing.cast("date")).alias("as_of_date"))


def watchlist_symbols(symbols, spark=None) -> DataFrame:
    """Distinct trimmed upper-case symbols from a frame, a comma-separated string or an iterable."""
    if isinstance(symbols, DataFrame):
        require_columns(symbols, ("symbol",), "watchlist")
        raw = symbols.select(F.explode(F.split(F.col("symbol").cast("string"), ",")).alias("symbol"))
    else:
        items = symbols.split(",") if isinstance(symbols, str) else [str(s) for s in symbols]
        raw = spark.createDataFrame([(s,) for s in items], "symbol string")
    return raw.select(symbol_key("symbol").alias("symbol")).filter("symbol <> ''").distinct()


def optional(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """Column if the frame has it, else a null (or the given default)."""
    if name in df.columns:
        return F.col(name)
    return F.lit(None) if default is None else default
