"""Rule checks on ledgers and accounts: every check is a table of findings."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.calendar import business_days_between
from panelspark.functions.scalar import fixed, percent, ratio
from panelspark.operators.ledger import LedgerConfig, account_summary, is_active, mark_positions, normalize_ledger

FINDING = ("account_id", "severity", "code", "message")


@dataclass(frozen=True)
class AuditConfig:
    max_sector_exposure: float = 0.35
    max_gross_exposure: float = 1.0
    max_price_staleness_days: int = 3
    tolerance: float = 0.01


def _finding(df: DataFrame, severity: str, code, message) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select("account_id", F.lit(severity).alias("severity"), code.alias("code"), message.alias("message"))


def check_cash(account: DataFrame) -> DataFrame:
    bad = account.filter(F.col("cash") < -0.01)
    return _finding(bad, "ERROR", "negative_cash", F.concat(F.lit("Paper account cash is negative: $"), fixed("cash"), F.lit(".")))


def check_duplicate_symbols(active: DataFrame) -> DataFrame:
    """Symbols with more than one active order; the message lists at most one entry per symbol."""
    counts = active.groupBy("account_id", F.upper("symbol").alias("symbol")).agg(F.count("*").alias("n")).filter("n > 1")
    return _finding(counts, "ERROR", "duplicate_active_symbols", F.format_string(
        "Active ledger contains duplicate symbol: %s(%d).", F.col("symbol"), F.col("n")))


def check_consistency(reported: DataFrame, calculated: DataFrame, tolerance: float) -> DataFrame:
    pair = reported.select("account_id", F.col("cash").alias("r_cash"), F.col("equity").alias("r_equity")).join(
        calculated.select("account_id", "cash", "equity"), "account_id")
    both = F.array(*[
        F.struct(F.lit(k).alias("name"), F.col(f"r_{k}").alias("reported"), F.col(k).alias("expected")) for k in ("cash", "equity")])
    rows = pair.select("account_id", F.explode(both).alias("x")).select("account_id", "x.*").filter(F.abs(F.col("reported") - F.col("expected")) > tolerance)
    return _finding(rows, "ERROR", F.concat(F.lit("account_"), F.col("name"), F.lit("_mismatch")), F.concat(
        F.lit("Reported "), F.col("name"), F.lit(" $"), fixed("reported"), F.lit(" differs from ledger value $"), fixed("expected"), F.lit(".")))


def check_freshness(prices: DataFrame, audit_date, max_days: int, accounts: DataFrame) -> DataFrame:
    latest = prices.agg(F.max(F.col("date").cast("date")).alias("latest"))
    days = F.datediff(F.lit(str(audit_date)).cast("date"), F.col("latest"))
    rows = accounts.select("account_id").distinct().join(F.broadcast(latest.withColumn("days", days)))
    missing = _finding(rows.filter("latest is null"), "ERROR", "missing_prices", F.lit("No price data was available."))
    stale = _finding(rows.filter(F.col("days") > max_days), "WARN", "stale_price_file", F.format_string(
        "Latest price file is %d calendar days behind the audit date.", F.col("days")))
    return missing.unionByName(stale)


def check_open_prices(open_marks: DataFrame, prices: DataFrame) -> DataFrame:
    latest = prices.agg(F.max(F.col("date").cast("date")).alias("latest"))
    rows = open_marks.join(F.broadcast(latest)).filter("latest_price_date is null or latest_price_date < latest")
    return _finding(rows.select("account_id", "symbol").distinct(), "WARN", "stale_open_position_prices",
                    F.concat(F.lit("Open position is missing its latest mark: "), F.col("symbol"), F.lit(".")))


def check_exposure(account: DataFrame, open_marks: DataFrame, config: AuditConfig) -> DataFrame:
    by_sector = open_marks.groupBy("account_id", "sector").agg(F.sum("mark_value").alias("value"))
    by_sector = by_sector.join(account.select("account_id", "equity"), "account_id")
    gross = by_sector.groupBy("account_id").agg(F.sum("value").alias("value"), F.max("equity").alias("equity"))
    broke = _finding(gross.filter("equity <= 0"), "ERROR", "non_positive_equity", F.lit("Paper equity is not positive."))
    alive = gross.filter("equity > 0").withColumn("r", ratio("value", "equity"))
    high = _finding(alive.filter(F.col("r") > config.max_gross_exposure), "WARN", "gross_exposure_high",
                    F.concat(F.lit("Gross exposure is "), percent("r"), F.lit(" of equity.")))
    sectors = by_sector.filter("equity > 0").withColumn("r", ratio("value", "equity")).filter(F.col("r") > config.max_sector_exposure)
    crowded = _finding(sectors, "WARN", "sector_exposure_high", F.concat(
        F.lit("Sector exposure exceeds limit: "), F.coalesce("sector", F.lit("null")), F.lit(": "), percent("r"), F.lit(".")))
    return broke.unionByName(high).unionByName(crowded)


def check_stale_orders(active: DataFrame, prices: DataFrame, sessions: int = 2) -> DataFrame:
    latest = prices.agg(F.max(F.col("date").cast("date")).alias("latest"))
    rows = active.filter("status = 'planned'").join(F.broadcast(latest))
    # one weekday is the plan date itself
    rows = rows.filter(business_days_between("planned_date", "latest") > sessions)
    return _finding(rows, "WARN", "stale_planned_orders", F.concat(
        F.lit("Planned order has waited more than two sessions: "), F.col("symbol"), F.lit(".")))


def run_audit(
    ledger: DataFrame, prices: DataFrame, *, reported: DataFrame | None = None, audit_date=None,
    config: AuditConfig | None = None, ledger_config: LedgerConfig | None = None,
) -> DataFrame:
    """All findings of all accounts."""
    config, ledger_config = config or AuditConfig(), ledger_config or LedgerConfig()
    df = normalize_ledger(ledger)
    active = df.filter(is_active())
    calculated = account_summary(df, prices, ledger_config)
    account = reported if reported is not None else calculated
    marks = mark_positions(df, prices, ledger_config).filter("status = 'open'")
    checks = [
        check_cash(account), check_duplicate_symbols(active), check_consistency(account, calculated, config.tolerance),
        check_open_prices(marks, prices), check_exposure(account, marks, config), check_stale_orders(active, prices),
    ]
    if audit_date is not None:
        checks.append(check_freshness(prices, audit_date, config.max_price_staleness_days, df))
    return functools.reduce(DataFrame.unionByName, checks)


def audit_summary(findings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Failed checks per account. A check counts once however many symbols it lists."""
    counts = findings.groupBy("account_id").agg(
        F.countDistinct(F.when(F.col("severity") == "ERROR", F.col("code"))).alias("errors"),
        F.countDistinct(F.when(F.col("severity") == "WARN", F.col("code"))).alias("warnings"))
    out = accounts.select("account_id").distinct().join(counts, "account_id", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("status", F.when(F.col("errors") > 0, "fail").otherwise("pass"))


def first_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """Top-n report per account, errors first."""
    order = Window.partitionBy("account_id").orderBy("severity", "code", "message")
    return findings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
