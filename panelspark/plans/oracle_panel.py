"""SQL for the panel queries."""

from __future__ import annotations

from panelspark.plans.oracle import lag, lead, plus_business_days, rolling, sql

W = (5, 10, 20, 40, 60, 120)


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def cols(items) -> str:
    return ", ".join(items)


sql("panel_prices", "panel", "SELECT symbol, date, volume, " + cols(
    ("open", "high", "low", "close", "adj_close")) + " FROM panel")
sql("panel_null_counts", "panel", "SELECT " + cols(
    f"count(*) - count({c}) AS {c}_nulls" for c in ("date", "symbol", "open", "high", "low", "close", "adj_close", "volume")
) + " FROM panel")
sql("panel_duplicate_keys", "", """
SELECT rows, count(*) AS keys FROM (SELECT count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber)
WHERE rows > 1 GROUP BY rows""")
sql("benchmark_split", "bench", """
SELECT 'tradable' AS side, count(*) AS rows, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date FROM panel
UNION ALL SELECT 'benchmark', count(*), 1, min(date), max(date) FROM bench""")

RET1 = f"ret1 AS (SELECT *, adj_close / {lag('adj_close')} - 1 AS return_1d FROM panel)"
sql("price_base_features", "panel", f"""
SELECT symbol, date, open * (adj_close / close) AS adj_open, {r("adj_close / " + lag('adj_close') + " - 1", 'return_1d')},
       {lead('open * (adj_close / close)')} AS next_open FROM panel""")
sql("price_return_features", "panel", RET1 + " SELECT symbol, date, " + cols(
    x for w in W for x in (
        r(f"adj_close / {lag('adj_close', w)} - 1", f"return_{w}d"), r(f"adj_close / {lag('adj_close', w)} - 1", f"momentum_{w}d"),
        r(rolling("stddev_samp", "return_1d", w), f"volatility_{w}d"), f"{lead('adj_close', w)} AS exit_close_{w}d")
) + " FROM ret1")
VOLS = RET1 + ", vols AS (SELECT *, " + cols(f"{rolling('stddev_samp', 'return_1d', w)} AS v{w}, adj_close / {lag('adj_close', w)} - 1 AS r{w}" for w in W) + " FROM ret1)"
sql("price_skip_and_ratio_features", "panel", VOLS + " SELECT symbol, date, " + cols(
    [r(f"{lag('adj_close', 5)} / {lag('adj_close', w + 5)} - 1", f"return_{w}d_skip_5d") for w in W[1:]]
    + [r(f"v{a} / nullif(v{b}, 0)", f"volatility_ratio_{a}d_{b}d") for a, b in zip(W, W[1:])]) + " FROM vols")
DV = "dv AS (SELECT *, adj_close * volume AS dollar_volume FROM panel)"
sql("price_volume_features", "panel", DV + " SELECT symbol, date, " + cols(
    [r(f"volume / {lag('volume', 5)} - 1", "volume_change_5d"), "dollar_volume", r("ln(1 + dollar_volume)", "log_dollar_volume")]
    + [x for w in (10, 20, 40, 120) for x in (
        r(rolling("avg", "volume", w), f"avg_volume_{w}d"), r(f"volume / ({rolling('avg', 'volume', w)})", f"relative_volume_{w}d"),
        r(f"ln(1 + ({rolling('avg', 'dollar_volume', w)}))", f"log_avg_dollar_volume_{w}d"))]) + " FROM dv")
sql("price_range_features", "panel", "SELECT symbol, date, " + cols(
    [r(f"adj_close / ({rolling('avg', 'adj_close', w)}) - 1", f"price_above_sma_{w}") for w in (10, 20, 50, 200)]
    + [x for w in (10, 20, 60, 120) for x in (
        r(f"adj_close / ({rolling('max', 'adj_close', w)}) - 1", f"distance_from_{w}d_high"),
        r(f"adj_close / ({rolling('max', 'adj_close', w)}) - 1", f"drawdown_{w}d"),
        r(f"({rolling('max', 'adj_close', w)}) / ({rolling('min', 'adj_close', w)}) - 1", f"high_low_range_{w}d"))]) + " FROM panel")
sql("price_lagged_features", "panel", VOLS + " SELECT symbol, date, " + cols(
    x for w in (5, 10, 20) for x in (r(lag(f"r{w}"), f"return_{w}d_lag_1"), r(lag(f"v{w}"), f"volatility_{w}d_lag_1"))) + " FROM vols")
sql("calendar_features", "panel", """
SELECT symbol, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
  round(sin(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS day_of_week_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS day_of_week_cos,
  round(sin(2 * pi() * (month(date) - 1) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * (month(date) - 1) / 12), 6) + 0.0 AS month_cos,
  CAST(last_day(date) - date AS INTEGER) AS days_to_month_end, CAST(date = last_day(date) AS INTEGER) AS is_month_end FROM panel""")


def zscore(c, name):
    return r(f"({c} - avg({c}) OVER (PARTITION BY date)) / nullif(stddev_samp({c}) OVER (PARTITION BY date), 0)", f"zscore_{name}")


FULL = VOLS + ", full0 AS (SELECT *, adj_close * volume AS dollar_volume, volume / (" + rolling("avg", "volume", 20) + ") AS rv20, volume / (" + rolling("avg", "volume", 10) + ") AS rv10, volume / " + lag("volume", 5) + " - 1 AS vc5 FROM vols), full1 AS (SELECT *, " + rolling("avg", "dollar_volume", 20) + " AS adv20, ln(1 + (" + rolling("avg", "dollar_volume", 20) + ")) AS ladv20 FROM full0)"
sql("cross_sectional_zscores", "panel", FULL + " SELECT symbol, date, " + cols(
    zscore(c, n) for c, n in (("r5", "return_5d"), ("r20", "return_20d"), ("v5", "volatility_5d"), ("v20", "volatility_20d"),
                              ("rv20", "relative_volume_20d"), ("ladv20", "log_avg_dollar_volume_20d"))) + " FROM full1")
sql("relative_strength_index", "panel", f"""
d AS (SELECT *, adj_close - {lag('adj_close')} AS delta FROM panel),
g AS (SELECT *, CASE WHEN delta > 0 THEN delta WHEN delta IS NOT NULL THEN 0 END AS up, CASE WHEN delta < 0 THEN -delta WHEN delta IS NOT NULL THEN 0 END AS down FROM d)
SELECT symbol, date, {r(f"100 - 100 / (1 + ({rolling('avg', 'up', 14)}) / nullif({rolling('avg', 'down', 14)}, 0))", 'rsi_14')} FROM g""")
sql("moving_average_convergence", "panel", """
n AS (SELECT symbol, date, adj_close AS p, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM panel),
e AS (SELECT symbol, i, date, p AS fast, p AS slow, CAST(0 AS DOUBLE) AS line, CAST(0 AS DOUBLE) AS sig FROM n WHERE i = 1
      UNION ALL
      SELECT n.symbol, n.i, n.date, fast * 11 / 13 + n.p * 2 / 13, slow * 25 / 27 + n.p * 2 / 27,
             (fast * 11 / 13 + n.p * 2 / 13) - (slow * 25 / 27 + n.p * 2 / 27),
             sig * 0.8 + 0.2 * ((fast * 11 / 13 + n.p * 2 / 13) - (slow * 25 / 27 + n.p * 2 / 27))
      FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT symbol, date, round(line, 4) + 0.0 AS macd_12_26, round(sig, 4) + 0.0 AS macd_signal_9, round(line - sig, 4) + 0.0 AS macd_histogram_12_26_9 FROM e""", recursive=True)
M20, S20 = rolling("avg", "adj_close", 20), rolling("stddev_samp", "adj_close", 20)
sql("bollinger_bands", "panel", f"""
b AS (SELECT symbol, date, adj_close, {M20} AS m, {S20} AS s FROM panel)
SELECT symbol, date, round((adj_close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0), 6) + 0.0 AS bollinger_pct_b_20_2,
       round(((m + 2 * s) - (m - 2 * s)) / m, 6) + 0.0 AS bollinger_width_20_2 FROM b""")
sql("average_true_range", "panel", f"""
p AS (SELECT *, {lag('adj_close')} AS pc FROM panel),
t AS (SELECT symbol, date, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p)
SELECT symbol, date, {r(rolling('avg', 'tr', 14), 'atr_14', 4)} FROM t""")
sql("interaction_features", "panel", FULL + """ SELECT symbol, date, round(r10 * v10, 6) + 0.0 AS return_10d_x_volatility_10d, round(r5 * v5, 6) + 0.0 AS return_5d_x_volatility_5d,
 round(v10 * rv10, 6) + 0.0 AS volatility_10d_x_relative_volume_10d, round(r20 * vc5, 6) + 0.0 AS return_20d_x_volume_change_5d FROM full1""")


def pct_rank(x, part):
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"
            f" / count({x}) OVER (PARTITION BY {part}) END")


sql("factor_proxies", "panel", VOLS + f" SELECT symbol, date, {r('r120 - r10', 'momentum_factor')}, {r('1 - (' + pct_rank('v20', 'date') + ')', 'low_vol_factor')}, {r('-v60', 'quality_factor')} FROM vols")
FULLS = FULL + ", secs AS (SELECT f.*, sector FROM full1 f LEFT JOIN universe USING (symbol))"
sql("sector_relative_features", "panel universe", FULLS + " SELECT symbol, date, sector, " + cols(
    [r(pct_rank(c, "date, sector"), f"sector_rank_{n}") for c, n in (
        ("r5", "return_5d"), ("r20", "return_20d"), ("r20", "momentum_20d"), ("v5", "volatility_5d"), ("v20", "volatility_20d"),
        ("rv20", "relative_volume_20d"), ("ladv20", "log_avg_dollar_volume_20d"))]
    + [x for w in (5, 20) for x in (r(f"avg(r{w}) OVER (PARTITION BY date, sector)", f"sector_return_{w}d"),
                                    r(f"r{w} - avg(r{w}) OVER (PARTITION BY date, sector)", f"stock_minus_sector_return_{w}d"))]) + " FROM secs")
MARKET = "market AS (SELECT date, " + cols(f"adj_close / lag(adj_close, {w}) OVER (ORDER BY date) - 1 AS m{w}" for w in (1, *W)) + " FROM bench)"


def beta(w, y="return_1d", x="m1"):
    o = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    n = f"sum(CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN 1 ELSE 0 END) {o} = {w}"
    return (f"CASE WHEN {n} THEN covar_samp({y}, {x}) {o} / nullif(var_samp({x}) {o}, 0) END",
            f"CASE WHEN {n} THEN corr({y}, {x}) {o} END")


WITHM = RET1 + ", " + MARKET + ", wm AS (SELECT ret1.*, market.* EXCLUDE (date), " + cols(f"ret1.adj_close / lag(ret1.adj_close, {w}) OVER (PARTITION BY symbol ORDER BY ret1.date) - 1 AS r{w}" for w in (5, 20)) + " FROM ret1 LEFT JOIN market USING (date))"
sql("market_relative_features", "panel bench", WITHM + " SELECT symbol, date, " + cols(
    [r("m1", "market_return_1d")]
    + [x for w in (5, 20) for x in (r(f"m{w}", f"market_return_{w}d"), r(f"r{w} - m{w}", f"stock_minus_market_return_{w}d"))]
    + [x for w in (60, 120) for x in (r(beta(w)[0], f"beta_{w}d"), r(beta(w)[1], f"correlation_to_market_{w}d"))]) + " FROM wm")
LABELS = "mf AS (SELECT date, " + cols(f"lead(adj_close, {h}) OVER (ORDER BY date) / adj_close - 1 AS mf{h}, lead(adj_close, {h}) OVER (ORDER BY date) / lead(open * (adj_close / close), 1) OVER (ORDER BY date) - 1 AS mx{h}" for h in (5, 20)) + " FROM bench), lf AS (SELECT panel.symbol, panel.date, " + cols(
    f"lead(panel.adj_close, {h}) OVER s / panel.adj_close - 1 AS f{h}, lead(panel.adj_close, {h}) OVER s / lead(panel.open * (panel.adj_close / panel.close), 1) OVER s - 1 AS x{h}" for h in (5, 20)) + " FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY date)), lab AS (SELECT lf.*, mf.* EXCLUDE (date) FROM lf LEFT JOIN mf USING (date))"
sql("forward_labels", "panel bench", LABELS + " SELECT symbol, date, " + cols(
    x for h in (5, 20) for x in (r(f"f{h}", f"fwd_{h}d_return"), r(f"f{h} - mf{h}", f"fwd_{h}d_excess_return"),
                                 r(f"x{h}", f"fwd_{h}d_exec_return"), r(f"x{h} - mx{h}", f"fwd_{h}d_exec_excess_return"))) + " FROM lab")
sql("discovery_derived_features", "panel", RET1 + ", neg AS (SELECT *, CASE WHEN return_1d < 0 THEN return_1d END AS down FROM ret1) SELECT symbol, date, " + cols(
    [r("return_1d", "return_1d")] + [r(f"adj_close / ({rolling('avg', 'adj_close', w)}) - 1", f"price_above_sma_{w}") for w in (20, 50, 200)]
    + [r(f"adj_close / ({rolling('max', 'adj_close', 252)}) - 1", n) for n in ("distance_from_52w_high", "drawdown_from_52w_high")]
    + [r(f"volume / ({rolling('avg', 'volume', 5)})", "relative_volume_5d"),
       r(f"(volume - ({rolling('avg', 'volume', 20)})) / nullif({rolling('stddev_samp', 'volume', 20)}, 0)", "volume_zscore_20d"),
       r(rolling("stddev_samp", "down", 20), "downside_volatility_20d"),
       r(f"adj_close / ({rolling('max', 'adj_close', 60)}) - 1", "max_drawdown_60d")]) + " FROM neg")
sql("volatility_table", "panel", RET1 + f", v AS (SELECT symbol, date, {r(rolling('stddev_samp', 'return_1d', 20), 'volatility')} FROM ret1) SELECT * FROM v WHERE volatility IS NOT NULL")
SECRET = RET1 + ", sd AS (SELECT date, sector, avg(return_1d) AS dr FROM ret1 JOIN universe USING (symbol) GROUP BY 1, 2 HAVING count(DISTINCT symbol) >= 3), sr AS (SELECT sector, date, " + rolling("avg", "dr", 5, "sector") + " AS sector_return FROM sd)"
sql("sector_return_table", "panel universe", SECRET + " SELECT sector, date, round(sector_return, 6) + 0.0 AS sector_return FROM sr WHERE sector_return IS NOT NULL")
sql("research_frame", "panel universe bench", FULLS + ", " + MARKET + ", " + LABELS + ", jm AS (SELECT secs.*, m1, m20 FROM secs LEFT JOIN market USING (date)) SELECT jm.symbol, jm.date, sector, " + cols([
    r("r20", "return_20d"), r("v20", "volatility_20d"),
    r("lag(adj_close, 5) OVER (PARTITION BY jm.symbol ORDER BY jm.date) / lag(adj_close, 25) OVER (PARTITION BY jm.symbol ORDER BY jm.date) - 1", "return_20d_skip_5d"),
    r("rv20", "relative_volume_20d"),
    *[x.replace("PARTITION BY symbol ORDER BY date", "PARTITION BY jm.symbol ORDER BY jm.date") for x in (
        r(f"adj_close / ({rolling('avg', 'adj_close', 50)}) - 1", "price_above_sma_50"),
        r(f"adj_close / ({rolling('max', 'adj_close', 60)}) - 1", "drawdown_60d"), r(beta(60)[0], "beta_60d"))],
    r(pct_rank("r20", "jm.date, sector"), "sector_rank_momentum_20d"), r(pct_rank("v20", "jm.date, sector"), "sector_rank_volatility_20d"),
    r("r20 - avg(r20) OVER (PARTITION BY jm.date, sector)", "stock_minus_sector_return_20d"), r("r20 - m20", "stock_minus_market_return_20d"),
    r("f5 - mf5", "fwd_5d_excess_return"), r("x20", "fwd_20d_exec_return")]) + " FROM jm JOIN lab ON lab.symbol = jm.symbol AND lab.date = jm.date")

sql("fundamentals_asof_join", "panel fund", """
SELECT p.symbol, p.date, adj_close AS adj_close, as_of_date AS fundamentals_as_of_date, market_cap, round(revenue_growth, 6) AS revenue_growth,
       round(gross_margin, 6) AS gross_margin, forward_pe, earnings_date
FROM panel p ASOF LEFT JOIN fund f ON p.symbol = f.symbol AND p.date >= f.as_of_date""")
sql("fundamentals_normalized", "fund", """
SELECT symbol, as_of_date, market_cap, round(revenue_growth, 6) AS revenue_growth, round(eps_growth, 6) AS eps_growth, forward_pe, earnings_date, source FROM fund""")
sql("fundamentals_latest", "fund", """
SELECT symbol, as_of_date, market_cap, round(return_on_equity, 6) AS return_on_equity FROM fund WHERE as_of_date <= DATE '1999-08-15'
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY as_of_date DESC) = 1""")
sql("quality_growth_eligibility", "fund", """
SELECT symbol, as_of_date, market_cap IS NOT NULL AND revenue_growth IS NOT NULL AND eps_growth IS NOT NULL
  AND (operating_margin IS NOT NULL OR gross_margin IS NOT NULL) AND return_on_equity IS NOT NULL AND debt_to_equity IS NOT NULL
  AND (forward_pe IS NOT NULL OR price_to_sales IS NOT NULL) AS eligible FROM fund""")
MONTHS = "months AS (SELECT max(date) AS as_of_date FROM panel GROUP BY date_trunc('month', date))"
sql("rebalance_dates", "panel", MONTHS + """
SELECT as_of_date, 'monthly' AS schedule FROM months
UNION ALL SELECT max(date), 'weekly' FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY date_trunc('week', date + 2)""")
sql("latest_rows_as_of", "panel", MONTHS + """, pairs AS (SELECT as_of_date, symbol FROM months CROSS JOIN (SELECT DISTINCT symbol FROM panel))
SELECT m.as_of_date, p.symbol, p.date, p.adj_close AS adj_close FROM pairs m ASOF JOIN panel p ON m.symbol = p.symbol AND m.as_of_date >= p.date""")
sql("next_available_price", "ledger", """
SELECT order_id, l.symbol, planned_date, p.date, p.open AS open FROM ledger l ASOF LEFT JOIN panel p ON l.symbol = p.symbol AND l.planned_date < p.date""")
sql("first_price_on_or_after_target", "ledger", """
SELECT order_id, l.symbol, target_exit_date, p.date, p.adj_close AS adj_close FROM ledger l ASOF LEFT JOIN panel p ON l.symbol = p.symbol AND l.target_exit_date <= p.date""")
sql("aligned_rebalance_dates", "panel", """
s AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS raw_date FROM panel)
SELECT raw_date, min(date) AS rebalance_date FROM s JOIN (SELECT DISTINCT date FROM panel) ON date >= raw_date GROUP BY raw_date""")
sql("latest_price_per_symbol", "panel", "SELECT symbol, max(date) AS date, arg_max(adj_close, date) AS adj_close FROM panel GROUP BY symbol")
sql("score_lookup_exact", "ledger scored", """
k AS (SELECT symbol, date, score FROM scored WHERE score IS NOT NULL)
SELECT l.order_id, l.symbol, l.target_exit_date AS date, e.score AS exact_score, a.score AS asof_score
FROM ledger l LEFT JOIN k e ON e.symbol = l.symbol AND e.date = l.target_exit_date
ASOF LEFT JOIN k a ON a.symbol = l.symbol AND l.target_exit_date >= a.date""")
sql("business_day_arithmetic", "weekdays", f"""
o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 50 AS INTEGER) AS step FROM orders)
SELECT day, step, (SELECT count(*) FROM weekdays WHERE d BETWEEN day AND day + step) - 1 AS between_days, {plus_business_days('day', 20)} AS plus_20,
  CASE isodow(day) WHEN 6 THEN day - 5 WHEN 7 THEN day - 6 ELSE day - 7 END AS minus_5,
  day + CAST((5 - isodow(day) + 7) % 7 AS INTEGER) AS week_end, strftime(day, '%Y-%m') AS month FROM o""")
