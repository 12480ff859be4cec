"""Panel-shaped inputs derived from the supplied tables, lazily and at any scale.

A supplier is a symbol: its number grows with the data while one supplier's history stays bounded by
the calendar. All derived numbers are exact (min, max and integer sums), so another engine deriving
the same inputs gets identical values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import calendar
from panelspark.functions.scalar import ratio
from panelspark.functions.windows import lag, lead


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(c):
    return F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 10, "0"))


@dataclass
class Inputs:
    """Lazy inputs for one data folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def prices(self) -> DataFrame:
        """One row per symbol and day. A symbol's lines go to one task, so neither the rows nor what looks at a symbol's history
        is shuffled again."""
        price, symbol = F.col("l_extendedprice") / F.col("l_quantity"), symbol_of("l_suppkey")
        lines = self.table("lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
        days = (
            lines.repartition(symbol).groupBy(symbol.alias("symbol"), "l_suppkey", "date")
            .agg(F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume"))
        )
        close = (F.col("high") + F.col("low")) / 2.0
        return days.select(
            "symbol", "date",
            (F.col("low") + (F.col("high") - F.col("low")) * 0.25).alias("open"),
            "high", "low", close.alias("close"), close.alias("adj_close"), "volume",
        )

    def lines(self) -> DataFrame:
        """The day of every line that :meth:`prices` is made of, so at least as many rows of a day."""
        return self.table("lineitem").select(F.to_date("l_shipdate").alias("date"))

    def days(self) -> DataFrame:
        """The days of :meth:`prices`, without making its rows."""
        return self.lines().distinct()

    def universe(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        # nation and region are fixed-size code tables
        joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(
            F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left"
        )
        return joined.select(
            symbol_of("s_suppkey").alias("symbol"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_suppkey") % 29 == 0, "etf").otherwise("equity").alias("category"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.when(F.col("s_suppkey") % 31 == 0, "Fund").otherwise("Common Stock").alias("security_type"),
        )

    def benchmark(self) -> DataFrame:
        """Equal-weight index: one row per date. Rounded so that the summation order cannot show."""
        p = self.prices()
        return p.groupBy("date").agg(
            *[F.round(F.avg(c), 4).alias(c) for c in ("open", "close", "adj_close")]
        )

    def fundamentals(self) -> DataFrame:
        q = F.last_day(F.add_months(F.date_trunc("quarter", F.col("l_shipdate")), 2))
        rows = self.table("lineitem").groupBy("l_suppkey", q.alias("as_of_date")).agg(
            F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"),
            F.max("l_discount").alias("d"), F.max("l_tax").alias("t"),
        )
        n, q = F.col("n"), F.col("q")
        return rows.select(
            symbol_of("l_suppkey").alias("symbol"), "as_of_date",
            (q * 1000000.0).alias("market_cap"),
            F.col("d").alias("revenue_growth"), F.col("t").alias("eps_growth"),
            F.when(n % 7 != 0, (n % 7) / 10.0).alias("gross_margin"),
            F.when(q % 11 != 0, (q % 11) / 20.0).alias("operating_margin"),
            (q * 10000.0 * (n % 3)).alias("free_cash_flow"),
            ((n % 5) / 2.0).alias("debt_to_equity"),
            F.when(q % 13 != 0, (q % 13) / 30.0).alias("return_on_equity"),
            (5.0 + q % 40).alias("forward_pe"), (1.0 + n % 9).alias("price_to_sales"),
            F.lit(None).cast("double").alias("peg_ratio"),
            F.date_add("as_of_date", (q % 40).cast("int")).alias("earnings_date"),
            F.lit("orders").alias("source"),
        )

    def marks(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("ts").cast("timestamp_ntz").alias("timestamp"), symbol_of("user_id").alias("symbol"),
            (F.col("value") * 10.0).alias("price"),
        )

    def dividends(self) -> DataFrame:
        """One event per symbol and quarter with a fixed per-share amount."""
        return self.prices().groupBy("symbol", F.date_trunc("quarter", "date").cast("date").alias("ex_date")).agg(
            F.lit(0.25).alias("dividend_per_share")
        )

    @staticmethod
    def with_scores(p: DataFrame, horizon: int = 5, score_window: int = 20) -> DataFrame:
        """A price panel with the trailing return as ``score`` and the later one as ``forward_return``."""
        # rounding keeps score ties and thresholds identical across engines
        score = F.round(ratio("adj_close", lag("adj_close", score_window)) - 1.0, 6)
        return p.withColumns({"score": score, "forward_return": ratio(lead("adj_close", horizon), "adj_close") - 1.0})

    def scored(self, horizon: int = 5, score_window: int = 20) -> DataFrame:
        """Score = trailing return, outcome = forward return, with execution prices."""
        df = self.with_scores(self.prices(), horizon, score_window).withColumns(
            {
                "adj_open": F.col("open") * ratio("adj_close", "close"),
                "exit_close": lead("adj_close", 20),
                "dollar_volume": F.col("adj_close") * F.col("volume"),
            }
        )
        frame = Window.partitionBy("symbol").orderBy("date").rowsBetween(-19, 0)
        adv = F.when(F.count("dollar_volume").over(frame) == 20, F.avg("dollar_volume").over(frame))
        df = df.withColumns({"next_open": lead("adj_open"), "avg_dollar_volume_20d": adv})
        df = df.withColumn("avg_dollar_volume_20d", F.round(adv, 4))
        return df.select(
            (F.year("date") - 1994).alias("split_id"), "date", "symbol", "score", "forward_return",
            "adj_close", "open", "close", "next_open", "exit_close", "avg_dollar_volume_20d",
        )

    def ledger(self) -> DataFrame:
        """Monthly orders per symbol: the latest is planned, the one before open, older ones closed.

        Accounts are groups of symbols. Orders are 10 shares bought at the next open; a closed order was
        sold at the close 20 rows after its plan date.
        """
        p = self.prices()
        df = p.withColumns(
            {
                "fill_date": lead("date"), "entry_price": lead("open"),
                "exit_date": lead("date", 20), "exit_price": lead("adj_close", 20),
                "score": F.round(ratio("adj_close", lag("adj_close", 20)) - 1.0, 6),
                "__first": F.row_number().over(
                    Window.partitionBy("symbol", F.trunc("date", "month")).orderBy("date")
                ),
            }
        ).filter("__first = 1 and fill_date is not null")
        back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
        df = df.withColumn("__back", back)
        status = (
            F.when(F.col("__back") == 1, "planned")
            .when((F.col("__back") <= 3) | F.col("exit_date").isNull(), "open")
            .when(F.col("__back") % 9 == 0, "skipped").otherwise("closed")
        )
        df = df.withColumn("status", status)
        filled = F.col("status").isin("open", "closed")
        closed = F.col("status") == "closed"
        entry, leave = F.lit(10.0) * F.col("entry_price"), F.lit(10.0) * F.col("exit_price")
        cost = 10.0 / 10000.0
        gross = leave - entry
        net = gross - entry * cost - leave * cost
        none = F.lit(None).cast("double")
        return df.select(
            F.concat(F.lit("A"), F.substring("symbol", -1, 1)).alias("account_id"),
            F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("-"), F.col("symbol")).alias("order_id"),
            "status", F.col("date").alias("planned_date"), "symbol",
            F.concat(F.lit("SEC"), F.substring("symbol", -1, 1)).alias("sector"), "score",
            F.when(F.col("status") == "skipped", 0.0).otherwise(10.0).alias("shares"),
            F.col("adj_close").alias("reference_price"),
            (F.lit(10.0) * F.col("adj_close")).alias("estimated_entry_value"),
            (F.lit(10.0) * F.col("adj_close") * cost).alias("estimated_cost"),
            calendar.add_business_days("date", F.lit(20)).alias("target_exit_date"),
            F.when(closed, F.col("exit_date")).alias("actual_exit_trigger_date"),
            F.when(filled, F.col("fill_date")).alias("fill_date"),
            F.when(filled, F.col("entry_price")).otherwise(0.0).alias("entry_price"),
            F.when(filled, entry).otherwise(0.0).alias("entry_value"),
            F.when(filled, entry * cost).otherwise(0.0).alias("entry_cost"),
            F.when(closed, F.col("exit_date")).alias("exit_date"),
            F.when(closed, F.col("exit_price")).otherwise(0.0).alias("exit_price"),
            F.when(closed, leave).otherwise(0.0).alias("exit_value"),
            F.when(closed, leave * cost).otherwise(0.0).alias("exit_cost"),
            F.when(closed, gross).otherwise(0.0).alias("gross_pnl"),
            F.when(closed, net).otherwise(0.0).alias("net_pnl"),
            F.when(closed, ratio(net, entry)).otherwise(0.0).alias("return"),
            F.when(closed, F.lit("horizon")).otherwise("").alias("exit_reason"),
            F.coalesce(F.when(closed, ratio(net, entry)), none, F.lit(0.0)).alias("exit_signal_value"),
            F.when(closed, F.lit("exit_rules.v2")).otherwise("").alias("exit_rule_version"),
            F.lit(0.0).alias("highest_close_since_entry"),
            F.lit(False).alias("trailing_stop_activated"),
            F.when(F.col("status") == "skipped", F.lit("insufficient_cash_at_fill")).otherwise("").alias("skip_reason"),
            F.lit(10.0).alias("requested_shares"),
            F.when(filled, 10.0).otherwise(0.0).alias("filled_shares"),
            F.lit(0.0).alias("borrow_cost"), F.lit(0.0).alias("dividends"),
        )
