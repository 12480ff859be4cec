"""Readers and normalisers for prices, dimensions, vendor frames and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.scalar import listing_symbol, number, symbol_key
from panelspark.operators.fundamentals import normalize_fundamentals
from panelspark.operators.validate import PRICE_COLUMNS, UNIVERSE_COLUMNS, validate_prices
from panelspark.session import require_columns

PRICE_FIELDS = ("open", "high", "low", "close", "adj_close", "volume")
MARK_COLUMNS = ("timestamp", "symbol", "price", "open", "high", "low", "close", "volume", "source")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """The table at ``path``, or an empty one with the same schema when it is missing."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as text columns named by its header."""
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def typed_prices(df: DataFrame) -> DataFrame:
    """Canonical price columns; a cell that is not a number or date fails the job."""
    require_columns(df, PRICE_COLUMNS, "prices")
    cols = {c: F.col(c).cast("double") for c in PRICE_FIELDS}
    return validate_prices(df.withColumns({**cols, "date": F.to_timestamp("date").cast("timestamp_ntz"), "symbol": F.upper("symbol")}).select(*PRICE_COLUMNS))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV or Parquet."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else _csv(spark, path)
    return typed_prices(raw)


def write_prices(df: DataFrame, path: str) -> None:
    """Panel partitioned by year, so that date filters prune directories."""
    df.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    require_columns(df, UNIVERSE_COLUMNS, "universe")
    return df.withColumn("symbol", F.upper("symbol"))


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    return normalize_fundamentals(_csv(spark, path))


def read_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """Score table, or nothing when it is missing or lacks the needed columns."""
    if not path_exists(spark, path):
        return None
    df = _csv(spark, path)
    if not {"symbol", "score"} <= set(df.columns):
        return None
    return df.withColumn("score", number("score"))


# Vendor spellings of the price columns.
VENDOR_NAMES = {
    "Date": "date", "Datetime": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close",
    "Volume": "volume",
}


def melt_vendor_frame(raw: DataFrame, symbols, time: str = "Date", sep: str = "|") -> DataFrame:
    """Wide vendor columns named ``TICKER|Field`` to one row per time and ticker.

    Tickers without columns are skipped. The reshape is a projection, so no shuffle is needed.
    """
    present = [s for s in symbols if any(c.startswith(f"{s}{sep}") for c in raw.columns)]
    if not present:
        raise ValueError("none of the symbols is in the vendor frame")
    fields = list(dict.fromkeys(c.split(sep, 1)[1] for c in raw.columns if sep in c))

    def cell(symbol, field):
        name = f"{symbol}{sep}{field}"
        value = F.col(f"`{name}`").try_cast("double") if name in raw.columns else F.lit(None).cast("double")
        return value.alias(VENDOR_NAMES.get(field, field.lower().replace(" ", "_")))

    rows = F.array(*[F.struct(F.lit(s.upper()).alias("symbol"), *[cell(s, f) for f in fields]) for s in present])
    return raw.select(F.col(time).alias("date"), F.explode(rows).alias("x")).select("date", "x.*")


def normalize_vendor_columns(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Rename vendor columns, default the adjusted close, drop the time zone, attach the symbol."""
    df = df.withColumnsRenamed({a: b for a, b in VENDOR_NAMES.items() if a in df.columns})
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    df = df.withColumn("date", F.to_timestamp("date").cast("timestamp_ntz"))
    return df.withColumn("symbol", F.lit(symbol.upper())) if symbol else df


def normalize_vendor_prices(raw: DataFrame, symbols, time: str = "Date", sep: str = "|") -> DataFrame:
    """Wide multi-ticker frame to the price panel; rows with any missing field are dropped."""
    long = normalize_vendor_columns(melt_vendor_frame(raw, symbols, time, sep))
    return long.select(*PRICE_COLUMNS).dropna()


def normalize_marks(df: DataFrame, source: str = "unknown") -> DataFrame:
    """Canonical intraday marks, for batch and streaming frames alike."""
    have = set(df.columns)
    if "timestamp" not in have and "date" in have:
        df = df.withColumnRenamed("date", "timestamp")
        have = set(df.columns)
    price_from, close_from = ("price" if "price" in have else "close"), ("close" if "close" in have else "price")
    require_columns(df, ("timestamp", "symbol", price_from), "intraday marks")
    price = number(price_from)
    other = {c: F.coalesce(number(c), price) if c in have else price for c in ("open", "high", "low")}
    out = df.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), symbol_key("symbol").alias("symbol"), price.alias("price"),
        *[other[c].alias(c) for c in ("open", "high", "low")], F.coalesce(number(close_from), price).alias("close"),
        (F.coalesce(number("volume"), F.lit(0.0)) if "volume" in have else F.lit(0.0)).alias("volume"),
        (F.col("source").cast("string") if "source" in have else F.lit(source)).alias("source"),
    )
    return out.dropna(subset=["timestamp", "symbol", "price"])


def normalize_vendor_intraday(raw: DataFrame, symbols, time: str = "Datetime", sep: str = "|", source: str = "vendor") -> DataFrame:
    """Wide intraday frame to marks; the price is the adjusted close where there is one."""
    long = normalize_vendor_intraday_columns(melt_vendor_frame(raw, symbols, time, sep))
    return normalize_marks(long, source)


def normalize_vendor_intraday_columns(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed({a: b for a, b in VENDOR_NAMES.items() if a in df.columns})
    if "date" not in df.columns:
        df = df.withColumnRenamed(df.columns[0], "date")
    price = F.coalesce("adj_close", "close") if "adj_close" in df.columns else F.col("close")
    return df.withColumn("price", price).withColumnRenamed("date", "timestamp")


# --- listings -------------------------------------------------------------------------------------

# Name fragments of listings that are not common stock, and exchange codes.
NON_COMMON_TERMS = (
    " warrant", " warrants", " right", " rights", " unit", " units", " preferred", " depositary", " note", " notes", " bond",
    " bonds", " debenture", " acquisition corp",
)
EXCHANGES = {"A": "NYSE American", "N": "NYSE", "P": "NYSE Arca", "Z": "Cboe BZX", "V": "IEX"}


def is_non_common(name):
    return F.lower(F.col(name) if isinstance(name, str) else name).rlike("|".join(NON_COMMON_TERMS))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "|").option("header", True).csv(path)


def listed_symbols(raw: DataFrame, *, symbol: str = "Symbol", exchange: str | None = None, note: str = "") -> DataFrame:
    """Common stock of a pipe-separated listing; the footer line and test issues are dropped."""
    code = F.col(exchange) if exchange else None
    name = F.trim(F.coalesce("Security Name", F.lit("")))
    venue = F.coalesce(F.create_map(*[F.lit(x) for kv in EXCHANGES.items() for x in kv])[code], code) if exchange else F.lit("NASDAQ")
    rows = raw.filter(~F.coalesce(F.col(symbol), F.lit("")).startswith("File Creation Time"))
    rows = rows.withColumns({"__s": listing_symbol(F.coalesce(F.col(symbol), F.lit(""))), "__n": name})
    rows = rows.filter((F.col("__s") != "") & (F.col("ETF") == "N") & (F.col("Test Issue") == "N") & ~is_non_common("__n"))
    return rows.select(
        F.col("__s").alias("symbol"), F.col("__n").alias("name"), F.lit("us_listed").alias("category"), F.lit("Unknown").alias("sector"),
        F.lit("Unknown").alias("industry"), venue.alias("exchange"), F.lit("Common Stock").alias("security_type"), F.lit(note).alias("notes"))


def nasdaq_listed(raw: DataFrame) -> DataFrame:
    return listed_symbols(raw, note="Generated from NASDAQ Trader nasdaqlisted.txt")


def other_listed(raw: DataFrame) -> DataFrame:
    return listed_symbols(raw, symbol="ACT Symbol", exchange="Exchange", note="Generated from NASDAQ Trader otherlisted.txt")


def us_listed(nasdaq: DataFrame, other: DataFrame) -> DataFrame:
    return nasdaq_listed(nasdaq).unionByName(other_listed(other))


def normalize_universe(df: DataFrame, arrival: str | None = None) -> DataFrame:
    """Clean symbols, first row per symbol, core columns first."""
    require_columns(df, UNIVERSE_COLUMNS, "universe")
    if arrival is None:
        arrival = "__arrival"
        df = df.withColumn(arrival, F.monotonically_increasing_id())
    rows = df.withColumn("symbol", listing_symbol("symbol")).filter("symbol <> ''")
    rest = [*UNIVERSE_COLUMNS[1:], *[c for c in df.columns if c not in UNIVERSE_COLUMNS and c != arrival]]
    kept = rows.groupBy("symbol").agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("__row"))
    return kept.select("symbol", *[F.col("__row")[c].alias(c) for c in rest])


# The benchmark row of the universe.
BENCHMARKS = {"SPY": ("SPDR S&P 500 ETF", "benchmark", "ETF", "Broad Market")}


def append_benchmark(universe: DataFrame, symbol: str = "SPY", row: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Add the benchmark's row unless the universe has it; columns it lacks stay null."""
    symbol = symbol.upper()
    values = row or BENCHMARKS.get(symbol)
    if values is None:
        raise ValueError(f"unsupported benchmark symbol: {symbol!r}")
    one = universe.sparkSession.createDataFrame([(symbol, *values)], ", ".join(f"{c} string" for c in UNIVERSE_COLUMNS))
    known = universe.filter(F.upper("symbol") == symbol).select(F.upper("symbol").alias("symbol")).distinct()
    return universe.unionByName(one.join(F.broadcast(known), "symbol", "left_anti"), allowMissingColumns=True)


def broad_universe(source: DataFrame, *, limit: int | None = None, benchmark: str | None = "SPY") -> DataFrame:
    """Normalised universe, with the benchmark appended; a caller may ask for the first ``limit`` symbols only."""
    out = normalize_universe(source)
    if limit is not None:
        if limit <= 0:
            raise ValueError("limit must be positive when provided")
        out = out.orderBy("symbol").limit(limit)
    return append_benchmark(out, benchmark) if benchmark else out


def append_promotions(universe: DataFrame, promotions: DataFrame) -> DataFrame:
    """Add promoted symbols that the universe does not have; existing rows win."""
    have = [c for c in (*UNIVERSE_COLUMNS, "notes") if c in promotions.columns and c in universe.columns]
    both = universe.withColumn("__p", F.lit(0)).unionByName(promotions.select(*have, F.lit(1).alias("__p")), allowMissingColumns=True)
    both = both.withColumn("symbol", F.upper("symbol"))
    rest = [c for c in universe.columns if c != "symbol"]
    kept = both.groupBy("symbol").agg(F.min_by(F.struct(*rest), F.col("__p")).alias("__row"))
    return kept.select("symbol", *[F.col("__row")[c].alias(c) for c in rest])


MARK_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("symbol", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("price", "open", "high", "low", "close", "volume")],
    T.StructField("source", T.StringType()),
])
