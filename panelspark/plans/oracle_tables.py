"""SQL for the source, store and stream queries."""

from __future__ import annotations

from panelspark.plans.oracle import SYM, sql

sql("typed_prices", "panel", "SELECT CAST(date AS TIMESTAMP) AS date, symbol, open, high, low, close, adj_close, volume FROM panel")
sql("vendor_frame_melted", "panel", """SELECT CAST(date AS TIMESTAMP) AS date, symbol, open, high, low, close, close AS adj_close, volume
FROM panel WHERE symbol IN (SELECT 'S' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 10, '0') FROM nation)""")
sql("normalized_marks", "", f"""
e AS (SELECT ts AS timestamp, {SYM.format('user_id')} AS symbol, value * 10 AS price, CASE WHEN event_id % 5 <> 0 THEN value * 11 END AS h, event_id FROM events WHERE event_id % 97 <> 0)
SELECT timestamp, symbol, round(price, 6) AS price, round(price, 6) AS open, round(coalesce(h, price), 6) AS high, round(price, 6) AS low, round(price, 6) AS close, 0.0 AS volume, 'events' AS source FROM e""")
sql("vendor_intraday_marks", "marks", """
h AS (SELECT date_trunc('hour', timestamp) AS timestamp, 'S' || lpad(CAST(1 + CAST(substr(symbol, 2) AS BIGINT) % (SELECT count(*) FROM nation) AS VARCHAR), 10, '0') AS symbol, max(price) AS p FROM marks GROUP BY 1, 2)
SELECT timestamp, symbol, round(p, 6) AS price, round(p, 6) AS open, round(p, 6) AS high, round(p, 6) AS low, round(p, 6) AS close, 0.0 AS volume, 'vendor' AS source FROM h""")
KIND = "(ARRAY[' Common Stock', ' Warrants', ' Preferred Series A', ' Ordinary Shares'])[1 + p_partkey % 4]"
COMMON = "p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_partkey % 4 NOT IN (1, 2)"
sql("nasdaq_listing", "", f"""SELECT upper(p_type) || '-' || p_partkey AS symbol, p_name || {KIND} AS name, 'us_listed' AS category, 'Unknown' AS sector, 'Unknown' AS industry,
'NASDAQ' AS exchange, 'Common Stock' AS security_type FROM part WHERE {COMMON}""")
sql("other_listing", "", f"""SELECT (ARRAY['NYSE American', 'NYSE', 'NYSE Arca', 'Cboe BZX', 'IEX', 'X'])[1 + CAST(right(p_brand, 1) AS INTEGER) % 6] AS exchange, count(*) AS listings FROM part WHERE {COMMON} GROUP BY 1""")
sql("us_listed_universe", "", f"SELECT 'us_listed' AS category, CASE WHEN right(p_brand, 1) IN ('1', '2') THEN 'NYSE' ELSE 'NASDAQ' END AS exchange, count(*) AS listings FROM part WHERE {COMMON} GROUP BY 1, 2")
sql("normalized_universe", "universe", "SELECT * FROM universe UNION ALL SELECT symbol || '-A', name, category, sector, industry, security_type FROM universe")
sql("broad_universe", "universe", "SELECT * FROM universe UNION ALL SELECT 'SPY', 'SPDR S&P 500 ETF', 'benchmark', 'ETF', 'Broad Market', NULL")
sql("appended_promotions", "universe", """SELECT symbol, CASE WHEN right(symbol, 1) = '3' THEN 'discovery' ELSE category END AS category, CASE WHEN right(symbol, 1) = '3' THEN 'promoted' ELSE '' END AS notes FROM universe""")
sql("watchlist_symbols", "", f"SELECT {SYM.format('c_nationkey')} AS symbol FROM customer UNION SELECT {SYM.format('c_custkey')} FROM customer")
sql("html_constituents", "universe", "SELECT symbol AS page_id, 1 AS row_ix, symbol || '-B' AS symbol, name, 'sp500' AS category, sector, 'A & ' || industry AS industry FROM universe")
sql("page_table_rows", "", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS tables, CAST(page_id % 4 + 1 + page_id % 3 AS BIGINT) AS rows FROM pages")
# file sizes and hashes as the file system has them, of the scale factor at which queries are compared
sql("input_file_metadata", "", "SELECT parse_filename(filename) AS file, size AS size_bytes, true AS exists, sha256(content) AS sha256, false AS hashed_in_blocks FROM read_blob('/root/testdata/sf0.01/*.parquet')")
sql("streaming_expired_marks", "marks", """SELECT symbol, max(timestamp) AS timestamp, arg_max(price, timestamp) AS price, max(timestamp) + INTERVAL 12 HOUR <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM marks) AS expired FROM marks GROUP BY symbol""")
sql("latest_rows_for_symbols", "panel universe", "SELECT symbol, max(date) AS date, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM panel SEMI JOIN universe USING (symbol) GROUP BY symbol")
sql("price_history_documents", "panel universe", "SELECT symbol, CAST(count(*) AS INTEGER) AS bars, min(date) AS first_date, max(close) AS highest FROM panel SEMI JOIN universe USING (symbol) GROUP BY symbol")
sql("merged_price_sources", "panel", """
m AS (SELECT symbol, date, CASE WHEN day(date) <= 20 THEN 0 ELSE 1 END AS fb FROM panel)
SELECT symbol, count(*) AS bars, min(date) AS first_date, sum(fb) AS from_fallback FROM m GROUP BY symbol""")
sql("merged_records", "universe", "SELECT symbol, CASE WHEN right(symbol, 1) = '1' THEN name ELSE 'fallback' END AS name, sector FROM universe WHERE right(symbol, 1) IN ('1', '2')")
sql("stock_documents", "panel universe ledger", """
SELECT u.symbol, CASE WHEN sector = 'ASIA' THEN u.name END AS name, u.sector, l.status AS position, strftime(r.d, '%Y-%m-%d') AS first_date
FROM universe u LEFT JOIN (SELECT symbol, status FROM ledger WHERE status = 'planned') l USING (symbol) LEFT JOIN (SELECT symbol, min(date) AS d FROM panel GROUP BY 1) r USING (symbol)""")
sql("collected_symbols", "universe ledger marks", "SELECT symbol FROM universe WHERE sector = 'ASIA' UNION SELECT symbol FROM ledger WHERE status = 'planned' UNION SELECT symbol FROM marks")
sql("ordered_lane_lists", "", f"""
l AS (SELECT DISTINCT {SYM.format('l_suppkey')} AS symbol, (ARRAY['value_recoveries', 'zeta', 'momentum_breakouts', 'alpha', ''])[1 + l_linenumber % 5] AS lane FROM lineitem)
SELECT symbol, string_agg(lane, ', ' ORDER BY CASE lane WHEN 'momentum_breakouts' THEN 1 WHEN 'value_recoveries' THEN 5 ELSE 9 END, lane) AS lanes FROM l WHERE lane <> '' GROUP BY symbol""")
sql("stable_order_ids", "", f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-' || {SYM.format('o_custkey')} || '-' ||
 printf('%03d', row_number() OVER (PARTITION BY o_orderdate ORDER BY o_custkey, o_orderkey)) AS order_id FROM orders""")
sql("scalar_functions", "", """
SELECT o_orderkey, 'BRK&' || upper(o_orderpriority) || '-A' AS ticker, printf('%.2f', o_totalprice) AS two_digits, printf('%03d', o_orderkey % 7) AS padded,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS state, round(o_totalprice / nullif(o_custkey % 5, 0), 4) AS safe_ratio,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS coerced,
  round(list_median(list_filter([CAST(o_custkey AS DOUBLE), CAST(o_orderkey AS DOUBLE), CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END], lambda x: x IS NOT NULL)), 4) AS middle,
  concat_ws('; ', CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN month(o_orderdate) = 12 THEN 'december' END) AS tags,
  sha256(CAST(o_orderkey AS VARCHAR)) AS digest FROM orders""")
sql("tagged_session_modes", "marks", "SELECT CASE WHEN strftime(timestamp, '%H:%M') < '08:30' THEN 'reconcile' WHEN strftime(timestamp, '%H:%M') < '15:45' THEN 'intraday-monitor' ELSE 'after-close' END AS mode, count(*) AS marks FROM marks GROUP BY 1")
sql("event_metric_maps", "", "SELECT event_id, json_extract_string(props, '$.k') AS props_k, event_type AS doc_kind, CAST(2 AS INTEGER) AS fields FROM events")
sql("history_rows", "", """SELECT CAST(event_id AS VARCHAR) AS run_id, strftime(ts, '%Y-%m-%d %H:%M') AS local_time, 'after-close' AS mode,
 CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '2024-01-31' END AS latest_price_date, value AS account_equity, CASE WHEN event_id % 3 <> 0 THEN 1.5 END AS backtest_sharpe, CAST(NULL AS VARCHAR) AS audit_status FROM events""")
sql("tolerant_json", "", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v, CAST(2 AS INTEGER) AS n, value AS cell FROM events")
sql("upserted_orders", "", """SELECT o_orderkey // 4 AS order_id, max(o_orderkey) AS updated_at, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1""")
sql("archived_orders", "ledger", "SELECT CASE WHEN planned_date < DATE '1998-01-01' THEN 'old' ELSE skip_reason END AS skip_reason, count(*) AS orders FROM ledger WHERE status = 'skipped' GROUP BY 1")
sql("deduplicated_marks", "marks", """
d AS (SELECT date_trunc('day', timestamp) AS timestamp, symbol, min(price) AS lo, max(CASE WHEN price > 2500 THEN price END) AS hi FROM marks GROUP BY 1, 2)
SELECT CAST(timestamp AS TIMESTAMP) AS timestamp, symbol, coalesce(hi, lo) AS price FROM d""")
sql("model_registry_best", "", "SELECT 'm' || s_suppkey AS model_id, 'ridge' AS model_type, s_acctbal AS metric_value FROM supplier WHERE s_suppkey % 2 = 0 ORDER BY s_acctbal DESC, 'm' || s_suppkey LIMIT 1")
sql("model_comparison", "", "SELECT 'm' || s_suppkey AS model_id, 'ridge' AS model_type, s_acctbal AS sharpe, CAST(s_nationkey AS DOUBLE) AS ic FROM supplier")
LATEST = "SELECT symbol, max(timestamp) AS timestamp, arg_max(price, timestamp) AS price FROM marks GROUP BY symbol"
sql("intraday_latest_marks", "marks", LATEST)
sql("streaming_latest_marks", "marks", LATEST)
sql("streaming_deduplicated_marks", "marks", "SELECT symbol, date_trunc('hour', timestamp) AS timestamp, round(max(price), 6) AS price FROM marks GROUP BY 1, 2")
BOOK = f"""lm AS ({LATEST}),
bk AS (SELECT u.symbol, 10.0 AS shares, 200.0 + n * 5 AS entry_price, 2000.0 + n * 50 AS entry_value, 100.0 + n * 12 AS old_high, price
       FROM (SELECT symbol, CAST(right(symbol, 3) AS INTEGER) AS n FROM universe) u LEFT JOIN lm USING (symbol)),
d1 AS (SELECT *, (shares * price - entry_value - 2.0) / entry_value AS current_return, CASE WHEN price IS NULL THEN old_high ELSE greatest(old_high, price) END AS highest FROM bk),
d2 AS (SELECT *, price IS NOT NULL AND highest / entry_price - 1 >= 0.12 AS armed FROM d1),
dec AS (SELECT *, CASE WHEN current_return <= -0.5 THEN 'intraday_stop_loss' WHEN armed AND price / highest - 1 <= -0.3 THEN 'intraday_trailing_stop' ELSE '' END AS exit_reason FROM d2)"""
sql("intraday_exit_decisions", "universe marks", BOOK + """
SELECT symbol, CASE WHEN price IS NULL THEN 'no_mark' WHEN exit_reason <> '' THEN 'exit' ELSE 'hold' END AS action, exit_reason <> '' AS triggered, round(price, 6) AS price,
 round(current_return, 6) AS current_return, round(highest, 6) AS highest_price_since_entry, armed AS trailing_stop_activated, exit_reason,
 round(CASE exit_reason WHEN 'intraday_stop_loss' THEN current_return WHEN 'intraday_trailing_stop' THEN price / highest - 1 END, 6) AS exit_signal_value FROM dec""")
LEDGERED = BOOK + """
SELECT 'O' || symbol AS order_id, CASE WHEN exit_reason <> '' THEN 'closed' ELSE 'open' END AS status, CASE WHEN exit_reason <> '' THEN round(price, 4) ELSE 0.0 END AS exit_price,
 CASE WHEN exit_reason <> '' THEN round(10 * price, 4) ELSE 0.0 END AS exit_value, CASE WHEN exit_reason <> '' THEN round(10 * price - entry_value - 2.0 - 10 * price * 0.001, 4) ELSE 0.0 END AS net_pnl, exit_reason FROM dec"""
sql("intraday_updated_ledger", "universe marks", LEDGERED)
sql("streaming_monitor_cycle", "universe marks", LEDGERED)
sql("intraday_decision_summary", "universe marks", BOOK + " SELECT exit_reason, count(*) AS positions, sum(CAST(exit_reason <> '' AS BIGINT)) AS triggered, count(DISTINCT symbol) AS symbols FROM dec GROUP BY exit_reason")
sql("positions_daily_highs", "ledger", "SELECT l.order_id, max(p.high) AS daily_high FROM ledger l JOIN panel p ON p.symbol = l.symbol AND p.date >= l.fill_date WHERE status = 'open' GROUP BY 1")
HOURS = """SELECT date_trunc('hour', timestamp) AS start, symbol, round(arg_min(price, timestamp), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low,
 round(arg_max(price, timestamp), 6) AS close, 0.0 AS volume, count(*) AS marks FROM marks GROUP BY 1, 2"""
sql("hourly_bars", "marks", HOURS)
sql("streaming_hourly_bars", "marks", f"SELECT * FROM ({HOURS}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM marks)")
sql("activity_sessions", "marks", """
g AS (SELECT symbol, timestamp, CASE WHEN timestamp < lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM marks),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY timestamp) AS k FROM g)
SELECT min(timestamp) AS start, max(timestamp) + INTERVAL 2 HOUR AS "end", symbol, count(*) AS events FROM s GROUP BY symbol, k""")
