"""Independent SQL for the registered queries, written for DuckDB on the raw tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

SYM = "'S' || lpad(CAST({0} AS VARCHAR), 10, '0')"

PANEL = f"""panel AS (
  SELECT symbol, date, low + (high - low) * 0.25 AS open, high, low, (high + low) / 2 AS close,
         (high + low) / 2 AS adj_close, volume
  FROM (SELECT {SYM.format('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS date,
               max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
               sum(l_quantity) AS volume
        FROM lineitem GROUP BY 1, 2))"""

UNIVERSE = f"""universe AS (
  SELECT {SYM.format('s_suppkey')} AS symbol, s_name AS name,
         CASE WHEN s_suppkey % 29 = 0 THEN 'etf' ELSE 'equity' END AS category,
         r_name AS sector, n_name AS industry,
         CASE WHEN s_suppkey % 31 = 0 THEN 'Fund' ELSE 'Common Stock' END AS security_type
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

BENCH = """bench AS (
  SELECT date, round(avg(open), 4) AS open, round(avg(close), 4) AS close,
         round(avg(adj_close), 4) AS adj_close FROM panel GROUP BY date)"""

FUND = f"""fund AS (
  SELECT symbol, as_of_date, q * 1000000.0 AS market_cap, d AS revenue_growth, t AS eps_growth,
         CASE WHEN n % 7 <> 0 THEN (n % 7) / 10.0 END AS gross_margin,
         CASE WHEN q % 11 <> 0 THEN (q % 11) / 20.0 END AS operating_margin,
         q * 10000.0 * (n % 3) AS free_cash_flow, (n % 5) / 2.0 AS debt_to_equity,
         CASE WHEN q % 13 <> 0 THEN (q % 13) / 30.0 END AS return_on_equity,
         CAST(5.0 + q % 40 AS DOUBLE) AS forward_pe, CAST(1.0 + n % 9 AS DOUBLE) AS price_to_sales,
         CAST(NULL AS DOUBLE) AS peg_ratio,
         as_of_date + CAST(q % 40 AS INTEGER) AS earnings_date, 'orders' AS source
  FROM (SELECT {SYM.format('l_suppkey')} AS symbol,
               CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS as_of_date,
               count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, max(l_discount) AS d, max(l_tax) AS t
        FROM lineitem GROUP BY 1, 2))"""

MARKS = f"""marks AS (
  SELECT ts AS timestamp, {SYM.format('user_id')} AS symbol, value * 10.0 AS price FROM events)"""


def rolling(agg: str, x: str, w: int, part: str = "symbol") -> str:
    """Aggregate over the last ``w`` rows, null until ``w`` values are present."""
    over = f"OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {w} THEN {agg}({x}) {over} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


SCORED = f"""scored AS (
  SELECT year(date) - 1994 AS split_id, date, symbol, round(score, 6) AS score, forward_return, adj_close, open, close,
         next_open, exit_close, round({rolling('avg', 'dv', 20)}, 4) AS avg_dollar_volume_20d
  FROM (SELECT *, adj_close / {lag('adj_close', 20)} - 1 AS score, {lead('adj_close', 5)} / adj_close - 1 AS forward_return,
               {lead('open * (adj_close / close)')} AS next_open, {lead('adj_close', 20)} AS exit_close,
               adj_close * volume AS dv FROM panel))"""

# weekday index arithmetic on a calendar of weekdays, independent of the closed form used in Spark
WEEKDAYS = """weekdays AS (
  SELECT d, row_number() OVER (ORDER BY d) AS i FROM
    (SELECT CAST(range AS DATE) AS d FROM range(TIMESTAMP '1990-01-01', TIMESTAMP '2010-01-01', INTERVAL 1 DAY))
  WHERE isodow(d) <= 5)"""


def plus_business_days(day: str, h: int) -> str:
    """Date ``h`` weekdays later: the h-th weekday after the day (a weekend day rolls back first)."""
    return (f"(CASE isodow({day}) WHEN 6 THEN {day} - 1 WHEN 7 THEN {day} - 2 ELSE {day} END + "
            f"{h // 5 * 7})")


LEDGER = f"""ledger0 AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM (
    SELECT *, {lead('date')} AS nd, {lead('open')} AS no, {lead('date', 20)} AS xd, {lead('adj_close', 20)} AS xp,
           round(adj_close / {lag('adj_close', 20)} - 1, 6) AS sc,
           row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) AS first_row
    FROM panel) WHERE first_row = 1 AND nd IS NOT NULL),
ledger1 AS (
  SELECT *, CASE WHEN back = 1 THEN 'planned' WHEN back <= 3 OR xd IS NULL THEN 'open'
                 WHEN back % 9 = 0 THEN 'skipped' ELSE 'closed' END AS status FROM ledger0),
ledger2 AS (
  SELECT *, status IN ('open', 'closed') AS filled, status = 'closed' AS done,
         10 * no AS ev, 10 * xp AS xv FROM ledger1),
ledger AS (
  SELECT 'A' || right(symbol, 1) AS account_id, strftime(date, '%Y-%m-%d') || '-' || symbol AS order_id, status,
         date AS planned_date, symbol, 'SEC' || right(symbol, 1) AS sector, sc AS score,
         CASE WHEN status = 'skipped' THEN 0.0 ELSE 10.0 END AS shares, adj_close AS reference_price,
         10 * adj_close AS estimated_entry_value, 10 * adj_close * 0.001 AS estimated_cost,
         {plus_business_days('date', 20)} AS target_exit_date,
         CASE WHEN done THEN xd END AS actual_exit_trigger_date, CASE WHEN filled THEN nd END AS fill_date,
         CASE WHEN filled THEN no ELSE 0 END AS entry_price, CASE WHEN filled THEN ev ELSE 0 END AS entry_value,
         CASE WHEN filled THEN ev * 0.001 ELSE 0 END AS entry_cost, CASE WHEN done THEN xd END AS exit_date,
         CASE WHEN done THEN xp ELSE 0 END AS exit_price, CASE WHEN done THEN xv ELSE 0 END AS exit_value,
         CASE WHEN done THEN xv * 0.001 ELSE 0 END AS exit_cost,
         CASE WHEN done THEN xv - ev ELSE 0 END AS gross_pnl,
         CASE WHEN done THEN xv - ev - ev * 0.001 - xv * 0.001 ELSE 0 END AS net_pnl,
         CASE WHEN done THEN (xv - ev - ev * 0.001 - xv * 0.001) / ev ELSE 0 END AS return_pct,
         CASE WHEN done THEN 'horizon' ELSE '' END AS exit_reason,
         CASE WHEN status = 'skipped' THEN 'insufficient_cash_at_fill' ELSE '' END AS skip_reason
  FROM ledger2)"""

BASE = {"panel": PANEL, "universe": UNIVERSE, "bench": BENCH, "fund": FUND, "marks": MARKS, "scored": SCORED,
        "ledger": LEDGER, "weekdays": WEEKDAYS}
NEEDS = {"bench": ["panel"], "scored": ["panel"], "ledger": ["panel"]}


def sql(name: str, uses: str, body: str, recursive: bool = False) -> None:
    """Register ``body`` with the named base tables in front of it.

    ``body`` may start with further ``name AS (...)`` tables followed by the final SELECT.
    """
    wanted = []
    for use in uses.split():
        for need in [*NEEDS.get(use, []), use]:
            if need not in wanted:
                wanted.append(need)
    text = ",\n".join(BASE[w] for w in wanted)
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not text:
        ORACLE[name] = body if body.upper().startswith(("SELECT", "(")) else head + body
    else:
        joint = "\n" if body.upper().startswith("SELECT") else ",\n"
        ORACLE[name] = head + text + joint + body


def load() -> None:
    """Fill :data:`ORACLE` from the topic modules."""
    from panelspark.plans import oracle_evaluation, oracle_panel, oracle_store, oracle_tables  # noqa: F401
