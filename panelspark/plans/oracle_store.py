"""SQL for the stored tables and the workflow."""

from __future__ import annotations

from panelspark.plans import oracle_evaluation, oracle_tables  # noqa: F401  (queries below share their SQL)
from panelspark.plans.oracle import ORACLE, sql

BOOK = """book AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'C' || o_custkey AS symbol,
  CASE WHEN o_orderkey % 6 = 0 THEN 'open' WHEN o_orderkey % 3 = 2 THEN 'closed' ELSE 'planned' END AS status FROM orders)"""
sql("stored_ledger", "", BOOK + " SELECT order_id, status, symbol FROM book")
sql("stored_open_positions", "", BOOK + " SELECT order_id, symbol FROM book WHERE status = 'open'")
sql("exported_ledger", "", BOOK + " SELECT status, count(*) AS orders, min(order_id) AS first_id, max(symbol) AS last_symbol FROM book GROUP BY 1")
sql("stored_run_history", "", """SELECT CAST(c_custkey AS VARCHAR) AS run_id, printf('2024-01-%02d', c_nationkey + 1) AS local_time,
 CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 5 <> 0 THEN c_acctbal END AS account_equity, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS mode FROM customer""")
sql("stored_snapshots", "", """SELECT 'A' || o_custkey AS account_id, CAST(o_orderdate AS DATE) AS snapshot_date,
 CASE WHEN day(CAST(o_orderdate AS DATE)) <= 10 THEN -1.0 ELSE max(o_totalprice) END AS equity FROM orders GROUP BY 1, 2""")
sql("stored_models", "", """SELECT 'm' || arg_max(s_suppkey, s_acctbal) AS model_id, 'ridge' AS model_type, max(s_acctbal) AS sharpe, count(*) AS models, 'm' || max(s_suppkey) AS newest
FROM supplier WHERE s_suppkey % 2 = 0""")
sql("stored_tables", "", "SELECT o_orderstatus AS kind, count(*) AS rows FROM orders GROUP BY 1 UNION ALL SELECT p_brand, count(*) FROM part GROUP BY 1")
ORACLE["stored_lanes"] = ORACLE["discovery_watchlists"]
# the portfolio has a row for every trading day from the first selection on
ORACLE["workflow_summary"] = f"""
WITH tr AS ({ORACLE["lane_backtest_trades"]})
SELECT 'discovery' AS stage, 'completed' AS status, count(*) AS rows FROM ({ORACLE["discovery_candidates"]})
UNION ALL SELECT 'lane_backtest', 'completed', count(*) FROM tr
UNION ALL SELECT 'portfolio_backtest', 'completed', count(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem WHERE CAST(l_shipdate AS DATE) >= (SELECT min(as_of_date) FROM tr)"""
sql("registered_walk_forward", "scored", oracle_evaluation.two_features(8) + f""",
w AS (SELECT *, {oracle_evaluation.both('500.0')} FROM m2 QUALIFY split_id = max(split_id) OVER ()),
x AS (SELECT date, symbol, score AS x1, ln(1 + avg_dollar_volume_20d) AS x2 FROM scored WHERE score IS NOT NULL AND avg_dollar_volume_20d IS NOT NULL)
SELECT date, symbol, round(my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2, 6) + 0.0 AS prediction, 'ridge' AS model_type, 1 AS version, (SELECT count(*) FROM ok) AS training_rows,
 (SELECT count(DISTINCT symbol) FROM ok) AS training_symbols, (SELECT count(*) FROM m2) AS split_count FROM x, w""")
sql("replaced_history", "", "SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_mktsegment AS mode, c_acctbal AS account_equity FROM customer")
sql("rebuilt_history", "", """SELECT strftime(d, '%Y-%m-%d') AS run_id, strftime(d, '%Y-%m-%d') || 'T18:00:00' AS local_time, 'after_close' AS mode, strftime(d, '%Y-%m-%d') AS latest_price_date, top AS account_equity, CAST(n AS DOUBLE) AS audit_error_count
FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)""")
sql("run_manifest_inputs", "", """SELECT 'research' AS run_type, '1999-06-15' AS as_of_date, '5' AS horizon, 'frame' AS frame, parse_filename(filename) AS file, size AS size_bytes, sha256(content) AS sha256
FROM read_blob('/root/testdata/sf0.01/*.parquet')""")
