"""SQL for evaluation, discovery, portfolio, ledger and report queries."""

from __future__ import annotations

from panelspark.operators.lanes import REASON_BODIES, REASON_LABELS
from panelspark.plans.oracle import lag, plus_business_days, rolling, sql
from panelspark.plans.oracle_panel import FULL, MARKET, MONTHS, SECRET, beta, pct_rank, r


def positions(fraction=0.1):
    return f"""
sr AS (SELECT split_id, date, symbol, score, forward_return AS f, count(*) OVER (PARTITION BY date) AS n,
       row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS hi, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS lo
       FROM scored WHERE score IS NOT NULL AND forward_return IS NOT NULL),
sk AS (SELECT *, greatest(1, CAST(floor(n * {fraction}) AS INTEGER)) AS k FROM sr),
pos AS (SELECT split_id, date, symbol, 'long' AS side, least(1.0 / k, 0.02) AS weight, f FROM sk WHERE hi <= k
        UNION ALL SELECT split_id, date, symbol, 'short', -least(1.0 / k, 0.02), f FROM sk WHERE lo <= k),
daily AS (SELECT split_id, date, sum(weight * f) AS gross_return, sum(abs(weight)) * 0.001 AS cost, sum(weight * f) - sum(abs(weight)) * 0.001 AS net_return,
          count(*) FILTER (side = 'long') AS long_count, count(*) FILTER (side = 'short') AS short_count, sum(abs(weight)) AS gross_exposure FROM pos GROUP BY 1, 2)"""


CUM = "OVER (PARTITION BY split_id ORDER BY date ROWS UNBOUNDED PRECEDING)"
sql("long_short_daily_returns", "scored", positions() + f"""
SELECT split_id, date, round(gross_return, 6) + 0.0 AS gross_return, round(cost, 6) AS cost, round(net_return, 6) + 0.0 AS net_return, long_count, short_count,
 round(gross_exposure, 6) AS gross_exposure, 1.0 AS leverage, round(net_return, 6) + 0.0 AS risk_net_return, true AS risk_trading_enabled,
 round(product(1 + net_return) {CUM}, 6) AS risk_equity FROM daily""")
sql("daily_positions", "scored", positions() + " SELECT split_id, date, symbol, side, round(weight, 6) AS weight, round(f, 6) + 0.0 AS realized_return, round(weight * f, 6) + 0.0 AS contribution FROM pos")
LEV = "OVER (PARTITION BY split_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
sql("volatility_targeted_returns", "scored", positions() + f""",
lev AS (SELECT *, least(greatest(coalesce(0.5 / nullif(CASE WHEN count(*) {LEV} = 20 THEN stddev_samp(net_return) {LEV} END * sqrt(252), 0), 1.0), 0.0), 1.5) AS leverage FROM daily)
SELECT split_id, date, round(net_return, 6) + 0.0 AS net_return, round(leverage, 6) AS leverage, round(net_return * leverage, 6) + 0.0 AS risk_net_return,
 round(product(1 + net_return * leverage) {CUM}, 6) AS risk_equity FROM lev""")
sql("drawdown_stop_returns", "scored", positions() + """,
nd AS (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY date) AS i FROM daily),
st AS (SELECT split_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS date, CAST(0 AS DOUBLE) AS r, true AS on_, CAST(1 AS DOUBLE) AS eq, CAST(1 AS DOUBLE) AS pk, 0 AS cool FROM (SELECT DISTINCT split_id FROM daily)
  UNION ALL
  SELECT split_id, i, date, r, on_, eq, pk, CASE WHEN on_ AND eq / pk - 1 <= -0.05 THEN 20 WHEN cool > 0 THEN cool - 1 ELSE cool END FROM (
    SELECT n.split_id, n.i, n.date, CASE WHEN st.cool <= 0 THEN n.net_return ELSE 0 END AS r, st.cool <= 0 AS on_,
           st.eq * (1 + CASE WHEN st.cool <= 0 THEN n.net_return ELSE 0 END) AS eq, greatest(st.pk, st.eq * (1 + CASE WHEN st.cool <= 0 THEN n.net_return ELSE 0 END)) AS pk, st.cool AS cool
    FROM st JOIN nd n ON n.split_id = st.split_id AND n.i = st.i + 1))
SELECT split_id, date, round(r, 6) + 0.0 AS risk_net_return, on_ AS risk_trading_enabled, round(eq, 6) AS risk_equity FROM st WHERE i > 0""", recursive=True)
sql("portfolio_diagnostics", "scored", positions() + """
SELECT split_id, date, round(net_return, 6) + 0.0 AS net_return, round(product(1 + net_return) OVER (ORDER BY split_id, date ROWS UNBOUNDED PRECEDING), 6) AS raw_equity,
 round(product(1 + net_return) OVER (ORDER BY split_id, date ROWS UNBOUNDED PRECEDING), 6) AS risk_equity_full FROM daily""")
sql("monthly_portfolio_returns", "scored", positions() + " SELECT strftime(date, '%Y-%m') AS month, round(product(1 + net_return) - 1, 6) + 0.0 AS raw_return, round(product(1 + net_return) - 1, 6) + 0.0 AS risk_return, count(*) AS trading_days FROM daily GROUP BY 1")
sql("symbol_contributions", "scored", positions() + """ SELECT symbol, count(*) FILTER (side = 'long') AS long_days, count(*) FILTER (side = 'short') AS short_days, round(sum(weight * f), 6) + 0.0 AS gross_contribution,
 round(avg(weight * f), 6) + 0.0 AS avg_daily_contribution, round(avg(abs(weight)), 6) AS avg_abs_weight FROM pos GROUP BY symbol""")
sql("return_metrics", "scored", positions() + f""",
eq AS (SELECT *, product(1 + net_return) {CUM} AS e FROM daily), dd AS (SELECT *, e / max(e) {CUM} - 1 AS d FROM eq)
SELECT split_id, round(avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(252), 6) AS sharpe, round(avg(net_return) / nullif(stddev_samp(net_return) FILTER (net_return < 0), 0) * sqrt(252), 6) AS sortino,
 round(avg(CAST(net_return > 0 AS DOUBLE)), 6) AS hit_rate, round(min(d), 6) + 0.0 AS max_drawdown FROM dd GROUP BY split_id""")
IC = """ok AS (SELECT * FROM scored WHERE score IS NOT NULL AND forward_return IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY split_id ORDER BY score) + (count(*) OVER (PARTITION BY split_id, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY split_id ORDER BY forward_return) + (count(*) OVER (PARTITION BY split_id, forward_return) - 1) / 2.0 AS b FROM ok)"""
sql("information_coefficients", "scored", IC + " SELECT split_id, round(corr(a, b), 6) + 0.0 AS ic FROM rk GROUP BY split_id")
sql("momentum_evaluation", "scored", positions().replace("score, forward_return AS f", "sc AS score, forward_return AS f").replace("FROM scored WHERE score IS NOT NULL", "FROM (SELECT *, adj_close / lag(adj_close, 20) OVER (PARTITION BY symbol ORDER BY date) - 1 AS sc FROM scored) WHERE sc IS NOT NULL").replace("ORDER BY score DESC", "ORDER BY sc DESC").replace("ORDER BY score, symbol", "ORDER BY sc, symbol") + """
SELECT date, round(gross_return, 6) + 0.0 AS gross_return, round(net_return, 6) + 0.0 AS net_return, long_count, short_count, round(product(1 + net_return) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS risk_equity FROM daily""")

# --- discovery --------------------------------------------------------------------------------------
SCORES = {
    "momentum_score": [("sr_r20", .25), ("sr_r20", .20), ("r60", .20), ("sms20", .15), ("smm20", .10), ("sma50", .05), ("hi52", .05)],
    "sector_strength_score": [("sec20", .30), ("sec60", .25), ("sr_r60", .20), ("sms20", .15), ("sms60", .10)],
    "attention_score": [("rv20", .35), ("rv5", .20), ("vz", .20), ("vc5", .15), ("abs1", .10)],
    "quality_score": [("revenue_growth", .20), ("eps_growth", .18), ("gross_margin", .10), ("operating_margin", .10), ("return_on_equity", .16), ("fcfy", .10), ("-debt_to_equity", .10), ("-forward_pe", .03), ("-price_to_sales", .03)],
    "value_recovery_score": [("-dd60", .20), ("r5", .15), ("sma20", .10), ("sma50", .10), ("rv20", .10), ("ey", .15), ("fcfy", .10), ("-forward_pe", .10)],
    "catalyst_score": [("ew", .25)],
}
WEIGHTS = {"momentum_score": .30, "quality_score": .20, "value_recovery_score": .20, "attention_score": .15, "sector_strength_score": .10, "catalyst_score": .05}
LANES = {"momentum_breakouts": "momentum_score", "sector_leaders": "sector_strength_score", "volume_anomalies": "attention_score", "quality_growth": "quality_score", "value_recoveries": "value_recovery_score"}
FRAME = FULL.replace("full1 AS (SELECT *", "full1 AS (SELECT *, " + ", ".join([
    f"adj_close / ({rolling('avg', 'adj_close', 20)}) - 1 AS sma20", f"adj_close / ({rolling('avg', 'adj_close', 50)}) - 1 AS sma50", f"adj_close / ({rolling('avg', 'adj_close', 200)}) - 1 AS sma200",
    f"adj_close / ({rolling('max', 'adj_close', 252)}) - 1 AS hi52", f"adj_close / ({rolling('max', 'adj_close', 60)}) - 1 AS dd60",
    f"volume / ({rolling('avg', 'volume', 5)}) AS rv5", f"(volume - ({rolling('avg', 'volume', 20)})) / nullif({rolling('stddev_samp', 'volume', 20)}, 0) AS vz",
    "abs(return_1d) AS abs1"])) + ", " + MARKET + f""",
withm AS (SELECT full1.*, m1, m20 FROM full1 LEFT JOIN market USING (date)),
withb AS (SELECT *, r20 - m20 AS smm20, {beta(60)[0]} AS beta60 FROM withm),
withf AS (SELECT b.*, f.* EXCLUDE (symbol), datediff('day', b.date, f.earnings_date) AS dte FROM withb b ASOF LEFT JOIN fund f ON b.symbol = f.symbol AND b.date >= f.as_of_date),
withu AS (SELECT w.*, u.name, u.category, u.sector, u.industry, u.security_type, free_cash_flow / nullif(market_cap, 0) AS fcfy, 1 / forward_pe AS ey,
          CASE WHEN dte BETWEEN 2 AND 30 THEN (31.0 - dte) / 29 END AS ew FROM withf w LEFT JOIN universe u USING (symbol)),
frame AS (SELECT *, avg(r20) OVER ds AS sec20, avg(r60) OVER ds AS sec60, r20 - avg(r20) OVER ds AS sms20, r60 - avg(r60) OVER ds AS sms60,
          {pct_rank('r20', 'date, sector')} AS sr_r20, {pct_rank('r60', 'date, sector')} AS sr_r60 FROM withu WINDOW ds AS (PARTITION BY date, sector))"""
REASONS = """concat_ws('; ', CASE WHEN symbol LIKE '%7' THEN 'already_in_watchlist' END, CASE WHEN category = 'etf' THEN 'excluded_category:etf' END,
  CASE WHEN security_type = 'Fund' THEN 'excluded_security_type:fund' END, CASE WHEN adj_close < 5 THEN 'price_below_minimum' END,
  CASE WHEN adv20 IS NULL THEN 'missing_avg_dollar_volume_20d' WHEN adv20 < 30000 THEN 'avg_dollar_volume_20d_below_minimum' END,
  CASE WHEN market_cap IS NULL THEN 'missing_market_cap' WHEN market_cap < 100000000 THEN 'market_cap_below_minimum' END,
  CASE WHEN dte BETWEEN 0 AND 1 THEN 'earnings_blackout' END)"""
COLS = sorted({c.lstrip("-") for parts in SCORES.values() for c, _ in parts})


def scored(source: str, key: str) -> str:
    """Tables ``kept`` and ``sco`` with the scores of the candidates of every ``key`` group."""
    pcts = []
    for c in sorted({c for parts in SCORES.values() for c, _ in parts}):
        x = c.lstrip("-")
        order = f"{x} DESC" if c.startswith("-") else x
        pcts.append(f"CASE WHEN {x} IS NULL THEN NULL WHEN min({x}) OVER (PARTITION BY {key}) = max({x}) OVER (PARTITION BY {key}) THEN 0.5 ELSE "
                    f"(rank() OVER (PARTITION BY {key} ORDER BY {order} NULLS LAST) + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {key}) END AS p_{'n' if c.startswith('-') else ''}{x}")

    def p(c):
        return f"p_{'n' if c.startswith('-') else ''}{c.lstrip('-')}"

    lines = []
    for name, parts in SCORES.items():
        top = " + ".join(f"coalesce({p(c)} * {w}, 0)" for c, w in parts)
        low = " + ".join(f"CASE WHEN {p(c)} IS NOT NULL THEN {w} ELSE 0 END" for c, w in parts)
        n = " + ".join(f"CASE WHEN {p(c)} IS NOT NULL THEN 1 ELSE 0 END" for c, w in parts)
        value = f"coalesce(({top}) / nullif({low}, 0), 0.5) * 100"
        if name == "quality_score":
            value, n = f"CASE WHEN elig THEN {value} ELSE 50 END", f"CASE WHEN elig THEN {n} ELSE 0 END"
        lines += [f"{value} AS {name}", f"CAST({n} AS INTEGER) AS {name}_inputs"]
    total = " + ".join(f"{s} * {w}" for s, w in WEIGHTS.items())
    return f"""
kept AS (SELECT *, market_cap IS NOT NULL AND revenue_growth IS NOT NULL AND eps_growth IS NOT NULL AND coalesce(operating_margin, gross_margin) IS NOT NULL
   AND return_on_equity IS NOT NULL AND debt_to_equity IS NOT NULL AND coalesce(forward_pe, price_to_sales) IS NOT NULL AS elig FROM {source} WHERE {REASONS} = ''),
pcts AS (SELECT *, {', '.join(pcts)} FROM kept),
sc0 AS (SELECT *, {', '.join(lines)} FROM pcts),
sco AS (SELECT *, ({total}) / {sum(WEIGHTS.values())} AS discovery_score FROM sc0)"""


def lanes(key: str) -> str:
    arms = []
    for lane, s in LANES.items():
        ok = "elig" if lane == "quality_growth" else f"{s}_inputs > 0"
        arms.append(f"SELECT *, '{lane}' AS lane, {s} AS lane_score FROM sco WHERE {ok}")
    return f"""
la AS ({' UNION ALL '.join(arms)}),
wl AS (SELECT *, row_number() OVER (PARTITION BY {key}, lane ORDER BY round(lane_score, 9) DESC NULLS LAST, round(discovery_score, 9) DESC NULLS LAST, round(adv20, 4) DESC NULLS LAST, symbol) AS rank FROM la QUALIFY rank <= 5)"""


NAMES = [*SCORES, "discovery_score"]
USES = "panel universe bench fund"
DAY = FRAME + ", today AS (SELECT * FROM frame WHERE date = DATE '1999-06-15'),"
ONE = DAY + scored("today", "date")
sql("discovery_candidates", USES, ONE + " SELECT date, symbol, " + ", ".join([*[r(s, s) for s in NAMES], *[f"{s}_inputs" for s in SCORES], "elig AS quality_score_eligible"]) + " FROM sco")
sql("discovery_explanations", USES, ONE + """
SELECT symbol, coalesce(nullif(array_to_string(list_filter([CASE WHEN momentum_score >= 80 THEN 'strong cross-sectional momentum score' END,
 CASE WHEN sector_strength_score >= 80 THEN 'sector-relative strength is ranking well' END, CASE WHEN attention_score >= 80 THEN 'volume or price attention signal is elevated' END,
 CASE WHEN quality_score >= 80 AND elig THEN 'quality and growth inputs rank well' END, CASE WHEN value_recovery_score >= 80 THEN 'value or recovery setup ranks well' END,
 CASE WHEN sms20 > 0 THEN printf('20-day return is %.1f%% above sector average', sms20 * 100) END, CASE WHEN rv20 >= 1.5 THEN printf('volume is %.1fx its 20-day average', rv20) END,
 CASE WHEN sma50 > 0 THEN 'price is above its 50-day moving average' END, CASE WHEN hi52 >= -0.05 THEN 'price is within 5% of its 52-week high' END], lambda x: x IS NOT NULL)[1:5], '; '), ''),
 'ranked well enough across available discovery inputs') AS why_flagged,
 concat_ws('; ', CASE WHEN dte BETWEEN 0 AND 7 THEN 'earnings in ' || dte || ' days' END, CASE WHEN v20 >= 0.05 THEN printf('20-day daily volatility is %.1f%%', v20 * 100) END,
 CASE WHEN adv20 < 60000 THEN 'liquidity is close to the discovery minimum' END, CASE WHEN beta60 >= 2 THEN printf('beta is elevated at %.1f', beta60) END,
 CASE WHEN sma200 < 0 THEN 'price is below its 200-day moving average' END, CASE WHEN forward_pe >= 50 THEN printf('forward P/E is high at %.1f', forward_pe) END) AS risk_flags FROM sco""")
sql("discovery_exclusions", USES, DAY + f" ex AS (SELECT date, symbol, name, sector, industry, {REASONS} AS exclusion_reasons FROM today) SELECT * FROM ex WHERE exclusion_reasons <> ''")
sql("discovery_exclusion_reasons_all_dates", USES, FRAME + f", ex AS (SELECT {REASONS} AS exclusion_reasons FROM frame) SELECT exclusion_reasons, count(*) AS rows FROM ex WHERE exclusion_reasons <> '' GROUP BY 1")
sql("discovery_scores_all_dates", USES, FRAME + "," + scored("frame", "date") + " SELECT date, symbol, " + ", ".join(r(f"{s} + 1e-9", s) for s in NAMES) + " FROM sco")
WL = ONE + "," + lanes("date")
sql("discovery_watchlists", USES, WL + " SELECT symbol, lane, CAST(rank AS INTEGER) AS rank, round(lane_score, 6) AS lane_score, round(discovery_score, 6) AS discovery_score FROM wl")
# texts as they are shown, by lane
REASONS_BY_LANE = " ".join(f"WHEN '{lane}' THEN '{REASON_LABELS[lane]}: {REASON_BODIES[lane]}'" for lane in LANES)
sql("lane_reasons", USES, WL + f" SELECT lane, symbol, upper(symbol) || ' - ' || CASE lane {REASONS_BY_LANE} END AS lane_reason FROM wl")
sql("discovery_top_fraction", USES, ONE + " SELECT date, symbol, round(discovery_score, 6) AS discovery_score FROM sco QUALIFY row_number() OVER (ORDER BY discovery_score DESC, symbol) <= greatest(1, ceil(count(*) OVER () * 0.2))")
sql("discovery_summary", USES, WL + f""", ex AS (SELECT {REASONS} AS x FROM today WHERE {REASONS} <> '')
SELECT (SELECT max(date) FROM sco) AS as_of_date, (SELECT count(*) FROM sco) AS candidate_count, (SELECT count(*) FROM ex) AS exclusion_count, (SELECT count(*) FROM ex WHERE contains(x, 'already_in_watchlist')) AS watchlist_exclusion_count,
 {', '.join(f"(SELECT count(*) FROM wl WHERE lane = '{x}') AS {x}" for x in LANES)},
 (SELECT count(*) FROM (SELECT symbol FROM wl GROUP BY 1 HAVING count(*) > 1)) AS multi_lane_candidate_count, (SELECT count(DISTINCT symbol) FROM universe) AS source_universe_count""")
sql("lane_membership", USES, WL + " SELECT symbol, string_agg(lane, ', ' ORDER BY lane) AS lanes_matched, CAST(count(*) AS INTEGER) AS lane_count FROM wl GROUP BY symbol")
ORDERED = "CASE lane " + " ".join(f"WHEN '{x}' THEN {n}" for n, x in enumerate(LANES)) + " END"
sql("multi_lane_candidates", USES, WL + f" SELECT date, symbol, any_value(name) AS name, any_value(sector) AS sector, any_value(industry) AS industry, string_agg(lane, ', ' ORDER BY {ORDERED}) AS lanes_matched, CAST(count(*) AS INTEGER) AS lane_count, round(max(discovery_score), 6) AS composite_score FROM wl GROUP BY 1, 2 HAVING count(*) > 1")
sql("missing_lanes", "", """SELECT 'volume_anomalies' AS lane, 'No eligible candidates had usable inputs for this lane.' AS explanation UNION ALL SELECT 'value_recoveries', 'No eligible candidates had usable inputs for this lane.'
UNION ALL SELECT 'quality_growth', 'quality_growth is empty because required fundamental fields are not present in the current price/volume/sector-only research frame.'""")
sql("populated_lanes", USES, WL + f" SELECT CAST(1 + {ORDERED} AS INTEGER) AS lane_order, lane, count(*) AS rows FROM wl GROUP BY lane")
BACK = FRAME + ", " + MONTHS + """,
fwd AS (SELECT *, lead(adj_close, 5) OVER s AS f5, lead(adj_close, 20) OVER s AS f20, lead(adj_close, 60) OVER s AS f60 FROM frame WINDOW s AS (PARTITION BY symbol ORDER BY date)),
pairs AS (SELECT as_of_date AS aod, symbol AS sym FROM months CROSS JOIN (SELECT DISTINCT symbol FROM panel)),
snap AS (SELECT p.aod, f.* FROM pairs p ASOF JOIN fwd f ON p.sym = f.symbol AND p.aod >= f.date),""" + scored("snap", "aod") + "," + lanes("aod")
sql("lane_backtest_trades", USES, BACK + " SELECT aod AS as_of_date, symbol, lane, CAST(rank AS INTEGER) AS rank, round(lane_score + 1e-9, 6) AS score, adj_close AS selection_price, " + ", ".join(
    f"f{h} AS forward_price_{h}d, {r(f'f{h} / adj_close - 1', f'forward_return_{h}d')}" for h in (5, 20, 60)) + ", sector FROM wl")
LSUM = BACK + ", lh AS (" + " UNION ALL ".join(f"SELECT lane, {h} AS horizon, f{h} / adj_close - 1 AS x FROM wl" for h in (5, 20, 60)) + """),
ls AS (SELECT lane, horizon, count(x) AS selections, avg(x) AS avg_forward_return, median(x) AS median_forward_return, avg(CAST(x > 0 AS DOUBLE)) AS win_rate, max(x) AS best_return, min(x) AS worst_return FROM lh GROUP BY 1, 2)"""
sql("lane_backtest_summary", USES, LSUM + " SELECT lane, horizon, selections, " + ", ".join(r(c, c) for c in ("avg_forward_return", "median_forward_return", "win_rate", "best_return", "worst_return")) + " FROM ls")
sql("best_and_worst_lanes", USES, LSUM + """ SELECT horizon, first(lane ORDER BY avg_forward_return DESC, lane) AS best_lane, round(max(avg_forward_return), 6) + 0.0 AS best_avg_return,
 first(lane ORDER BY avg_forward_return, lane) AS worst_lane, round(min(avg_forward_return), 6) + 0.0 AS worst_avg_return FROM ls GROUP BY horizon""")

# --- portfolio --------------------------------------------------------------------------------------
SEL = MONTHS + """, pr AS (SELECT as_of_date AS aod, symbol AS sym FROM months CROSS JOIN (SELECT DISTINCT symbol FROM panel)),
sel0 AS (SELECT p.aod AS as_of_date, s.symbol, s.score FROM pr p ASOF JOIN (SELECT * FROM scored WHERE score IS NOT NULL) s ON p.sym = s.symbol AND p.aod >= s.date),
sel AS (SELECT *, CASE WHEN score > 0 THEN 'momentum_breakouts' ELSE 'value_recoveries' END || CASE WHEN score > 0.5 THEN ', sector_leaders' ELSE '' END AS lanes, CASE WHEN score > 0.5 THEN 2 ELSE 1 END AS n FROM sel0)"""
sql("deduplicated_selections", "scored", SEL + " SELECT as_of_date, symbol, lanes AS lanes_matched, lanes AS lane_source, CAST(n AS INTEGER) AS lane_count, score, 1.0 AS rank FROM sel")
TOP = SEL + ", tgt AS (SELECT *, count(*) OVER (PARTITION BY as_of_date) AS c FROM (SELECT * FROM sel QUALIFY row_number() OVER (PARTITION BY as_of_date ORDER BY score DESC, symbol) <= 10))"
sql("portfolio_holdings", "scored", TOP + " SELECT as_of_date AS rebalance_date, symbol, round(1.0 / c, 6) AS weight, lanes AS lane_source, lanes AS lanes_matched, score FROM tgt")
# value of the portfolio by stepping through rebalance dates: gross growth, then cost on moved weight
PF = TOP + """,
rd AS (SELECT as_of_date AS k, lead(as_of_date) OVER (ORDER BY as_of_date) AS nk, row_number() OVER (ORDER BY as_of_date) AS i FROM (SELECT DISTINCT as_of_date FROM tgt)),
h AS MATERIALIZED (SELECT rd.i, rd.k, rd.nk, t.symbol, 1.0 / t.c AS w, p.adj_close AS p0 FROM rd JOIN tgt t ON t.as_of_date = rd.k ASOF JOIN panel p ON p.symbol = t.symbol AND rd.k >= p.date),
hc AS MATERIALIZED (SELECT h.*, h.w * p.adj_close / h.p0 AS wr FROM (SELECT * FROM h WHERE nk IS NOT NULL) h ASOF JOIN panel p ON p.symbol = h.symbol AND h.nk >= p.date),
prs AS (SELECT coalesce(a.i, b.i + 1) AS i, coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.w, 0) AS nw, coalesce(b.wr, 0) AS ow, coalesce(b.w, 0) AS w0 FROM h a FULL JOIN hc b ON a.i = b.i + 1 AND a.symbol = b.symbol),
lst AS MATERIALIZED (SELECT i, list({'nw': nw, 'ow': ow}) AS x, 1 - sum(w0) + sum(ow) AS growth FROM prs GROUP BY i),
val AS (SELECT CAST(0 AS BIGINT) AS i, CAST(1 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS gross
  UNION ALL SELECT l.i, v.g * (l.growth - v.c), list_sum(list_transform(l.x, lambda e: abs(e.nw - e.ow / (l.growth - v.c)))) * 0.001, l.growth - v.c FROM val v JOIN lst l ON l.i = v.i + 1),
days AS (SELECT DISTINCT date FROM panel),
cell AS MATERIALIZED (SELECT d.date, h.i, h.k, h.nk, h.symbol, h.w, h.p0 FROM days d JOIN h ON d.date >= h.k AND (h.nk IS NULL OR d.date < h.nk)),
now AS MATERIALIZED (SELECT c.*, CASE WHEN c.date = c.k THEN c.p0 ELSE p.adj_close END AS p FROM cell c ASOF JOIN panel p ON p.symbol = c.symbol AND c.date >= p.date),
pv AS (SELECT n.date, n.k, n.i, 1 - sum(w) + sum(w * p / p0) AS growth FROM now n GROUP BY 1, 2, 3),
port AS (SELECT pv.date, pv.date = pv.k AS first_day, v.g, v.c, v.g * (pv.growth - v.c) AS value FROM pv JOIN val v USING (i)),
pd AS (SELECT date, CASE WHEN first_day THEN g * c ELSE 0 END AS tc, CASE WHEN first_day THEN g ELSE value END AS gv, value, coalesce(lag(value) OVER (ORDER BY date), 1) AS before FROM port)"""
sql("portfolio_daily_returns", "scored", PF + " SELECT date, round(gv / before - 1, 6) + 0.0 AS gross_return, round(tc * 100000, 2) AS transaction_cost, round(value / before - 1, 6) + 0.0 AS net_return, round(value, 6) AS portfolio_value FROM pd", recursive=True)
MOVED = PF + ", tr AS (SELECT rd.k AS rebalance_date, p.symbol, ow / v.gross AS old_weight, nw AS new_weight, abs(nw - ow / v.gross) AS trade_weight FROM prs p JOIN val v USING (i) JOIN rd USING (i) WHERE abs(nw - ow / v.gross) > 1e-12)"
sql("portfolio_trades", "scored", MOVED + " SELECT rebalance_date, symbol, round(old_weight, 6) AS old_weight, round(new_weight, 6) AS new_weight, round(trade_weight, 6) AS trade_weight, CASE WHEN new_weight > old_weight THEN 'buy' ELSE 'sell' END AS side FROM tr", recursive=True)
sql("portfolio_summary", "scored", MOVED + """, nr AS (SELECT *, value / before - 1 AS x, value / max(value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM pd)
SELECT 100000.0 AS starting_capital, round(arg_max(value, date) * 100000, 6) AS ending_capital, round(arg_max(value, date) - 1, 6) AS total_return, round(pow(arg_max(value, date), 252.0 / (count(*) - 1)) - 1, 6) AS annualized_return,
 round(stddev_pop(x) * sqrt(252), 6) AS annualized_volatility, round(avg(x) / stddev_pop(x) * sqrt(252), 6) AS sharpe_ratio, round(sum(tc) * 100000, 6) AS total_transaction_cost, round(min(dd), 6) AS max_drawdown,
 (SELECT round(avg(t), 6) FROM (SELECT sum(trade_weight) AS t FROM tr GROUP BY rebalance_date)) AS average_turnover, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM tgt GROUP BY as_of_date)) AS number_of_positions_average,
 (SELECT count(*) FROM rd) AS number_of_rebalances FROM nr""", recursive=True)
VOL = TOP + f""", rets AS (SELECT symbol, date, adj_close / {lag('adj_close')} - 1 AS x FROM panel), rv AS (SELECT symbol, date, stddev_samp(x) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS vol FROM rets),
iv AS (SELECT t.as_of_date, t.symbol, t.c, coalesce(1 / nullif(v.vol, 0), 0) AS raw FROM tgt t ASOF JOIN rv v ON v.symbol = t.symbol AND t.as_of_date >= v.date),
nw AS (SELECT *, raw / sum(raw) OVER (PARTITION BY as_of_date) AS w FROM iv)"""
# water filling: repeat "cap what is above, share the rest in proportion"
FILL = """, f0 AS (SELECT as_of_date, symbol, w, w AS cur, false AS capped, 0 AS step FROM nw),
fill AS (SELECT * FROM f0 UNION ALL
  SELECT as_of_date, symbol, w, CASE WHEN now_capped THEN 0.15 ELSE w * (1 - 0.15 * count(*) FILTER (now_capped) OVER (PARTITION BY as_of_date)) / nullif(sum(CASE WHEN now_capped THEN 0 ELSE w END) OVER (PARTITION BY as_of_date), 0) END, now_capped, step + 1
  FROM (SELECT *, capped OR cur > 0.15 + 1e-12 AS now_capped FROM fill WHERE step < 12))"""
sql("inverse_volatility_weights", "scored", VOL + FILL + " SELECT as_of_date AS rebalance_date, symbol, round(cur, 6) AS weight FROM fill WHERE step = 12", recursive=True)
sql("weight_turnover", "scored", VOL + " SELECT as_of_date AS rebalance_date, round(sum(abs(w - 1.0 / c)), 6) + 0.0 AS turnover FROM nw GROUP BY 1")
sql("forward_filled_prices", "panel", """
d AS (SELECT DISTINCT date AS day FROM panel), c AS (SELECT day, symbol AS sym FROM d CROSS JOIN (SELECT DISTINCT symbol FROM panel)),
f AS (SELECT c.day, p.adj_close FROM c ASOF JOIN panel p ON p.symbol = c.sym AND c.day >= p.date)
SELECT day AS date, count(*) AS symbols, min(adj_close) AS lowest, max(adj_close) AS highest FROM f GROUP BY day""")

# --- ledger -----------------------------------------------------------------------------------------
CAND = """cand AS (SELECT 'A' || right(symbol, 1) AS account_id, CAST(date_trunc('month', date) AS DATE) AS date, symbol, arg_min(score, date) AS score, arg_min(adj_close, date) AS adj_close FROM scored WHERE score IS NOT NULL
  GROUP BY symbol, date_trunc('month', date))"""


def planned(excluded: str, cash: str) -> str:
    return CAND + f""",
c1 AS (SELECT *, row_number() OVER (PARTITION BY account_id, date ORDER BY score DESC, symbol) AS k, greatest(1, CAST(floor(count(*) OVER (PARTITION BY account_id, date) * 0.4) AS INTEGER)) AS lim,
        floor(7500.0 / adj_close) AS sh, {excluded} AS busy FROM cand),
c2 AS (SELECT *, sh * adj_close + sh * adj_close * 0.001 AS need FROM c1),
go AS (SELECT account_id, date, CAST(0 AS BIGINT) AS k, CAST({cash} AS DOUBLE) AS cash, 0 AS taken, '' AS reason FROM (SELECT DISTINCT account_id, date FROM c2)
  UNION ALL
  SELECT account_id, date, k, CASE WHEN reason = '' THEN cash - need ELSE cash END, CASE WHEN reason = '' THEN taken + 1 ELSE taken END, reason FROM (
    SELECT c.account_id, c.date, c.k, go.cash, go.taken, c.need, CASE WHEN busy THEN 'symbol_already_open' WHEN score < 0.01 THEN 'score_below_threshold' WHEN go.taken >= lim THEN 'rank_below_position_count'
      WHEN sh <= 0 THEN 'size_too_small' WHEN need > go.cash THEN 'insufficient_cash' ELSE '' END AS reason
    FROM go JOIN c2 c ON c.account_id = go.account_id AND c.date = go.date AND c.k = go.k + 1)),
plan AS (SELECT c2.*, go.reason, go.cash FROM go JOIN c2 USING (account_id, date, k))"""


PLAN = planned("false", "150000")
sql("planned_orders", "scored", PLAN + f""" SELECT account_id, date AS planned_date, symbol, score, CASE WHEN reason = '' THEN 'planned' ELSE 'skipped' END AS status, reason AS skip_reason, CASE WHEN reason = '' THEN sh ELSE 0 END AS shares,
 {plus_business_days('date', 20)} AS target_exit_date, CAST(k AS INTEGER) AS rank FROM plan""", recursive=True)
sql("planned_orders_with_context", "scored ledger", planned("symbol IN (SELECT symbol FROM ledger WHERE status = 'open' AND (symbol LIKE '%5' OR symbol LIKE '%12'))", "20000") + """
SELECT account_id, strftime(date, '%Y-%m-%d') || '-' || symbol || '-' || printf('%03d', row_number() OVER (PARTITION BY account_id, date ORDER BY k)) AS order_id, symbol, sh AS shares, round(cash, 2) AS remaining_cash FROM plan WHERE reason = ''""", recursive=True)
sql("appended_orders", "scored ledger", PLAN + """,
kn AS (SELECT * FROM ledger WHERE (symbol LIKE '%2' OR planned_date < DATE '1999-01-01') AND (status <> 'open' OR symbol LIKE '%2'))
SELECT account_id, strftime(date, '%Y-%m-%d') || '-' || symbol AS order_id, symbol FROM plan p WHERE reason = '' AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.symbol = p.symbol AND (status IN ('open', 'planned') OR planned_date = p.date))""", recursive=True)
sql("skip_reason_counts", "scored", PLAN + " SELECT account_id, reason AS skip_reason, count(*) AS rows FROM plan WHERE reason <> '' GROUP BY 1, 2", recursive=True)
TODAY = PLAN + """, act AS (SELECT p.account_id, p.symbol, p.date, reason = '' AS planned, p.need * CAST(reason = '' AS INTEGER) AS need,
  CASE WHEN p.symbol IN (SELECT symbol FROM ledger WHERE status IN ('planned', 'open')) THEN 'blocked_active_symbol' WHEN reason = '' AND need > 5000 THEN 'blocked_insufficient_cash' WHEN reason = '' THEN 'actionable_new_order' ELSE 'skipped_' || reason END AS effective_action
  FROM plan p WHERE date = DATE '1999-06-01')"""
sql("actionability", "scored ledger", TODAY + " SELECT account_id, symbol, date AS plan_date, effective_action, effective_action = 'actionable_new_order' AS actionable_new_order FROM act", recursive=True)
sql("actionability_summary", "scored ledger", TODAY + """ SELECT account_id, count(*) AS candidate_count, count(*) FILTER (planned) AS model_planned_count, count(*) FILTER (effective_action = 'actionable_new_order') AS actionable_new_order_count,
 round(coalesce(sum(need) FILTER (effective_action = 'actionable_new_order'), 0), 2) AS actionable_estimated_required_cash, count(*) FILTER (effective_action = 'blocked_active_symbol') AS blocked_by_active_symbol_count, true AS plan_is_latest_price_date FROM act GROUP BY 1""", recursive=True)
# only planned orders are candidates for a fill; the cash of each account comes from its filled orders
DUP = """dl AS (SELECT *, status IN ('planned', 'open') AND row_number() OVER (PARTITION BY account_id, symbol, status IN ('planned', 'open') ORDER BY planned_date, fill_date NULLS LAST, order_id) > 1 AS dup FROM ledger),
l2 AS (SELECT * REPLACE (CASE WHEN dup THEN 'skipped' ELSE status END AS status, CASE WHEN dup THEN 'duplicate_active_symbol' ELSE skip_reason END AS skip_reason, CASE WHEN dup THEN NULL ELSE fill_date END AS fill_date,
   CASE WHEN dup THEN NULL ELSE entry_price END AS entry_price, CASE WHEN dup THEN 0 ELSE entry_value END AS entry_value, CASE WHEN dup THEN 0 ELSE entry_cost END AS entry_cost, CASE WHEN dup THEN 0 ELSE shares END AS shares) FROM dl)"""
sql("filled_orders", "ledger", DUP + " SELECT order_id, status, fill_date, entry_price, entry_value, entry_cost, round(shares, 4) AS shares, skip_reason FROM l2")
sql("deduplicated_active_orders", "ledger", DUP + " SELECT account_id, status, skip_reason, count(*) AS orders FROM l2 GROUP BY 1, 2, 3")
SCO = "k AS (SELECT symbol, date, score FROM scored WHERE score IS NOT NULL)"


def bdays(a: str, b: str) -> str:
    """Weekdays in (a, b] for weekday ``a``, by counting on the numbered calendar."""
    return f"((SELECT max(i) FROM weekdays WHERE d <= {b}) - (SELECT max(i) FROM weekdays WHERE d <= {a}))"


sql("exit_decisions", "ledger scored universe weekdays", SECRET.replace("FROM ret1 JOIN universe USING (symbol)", "FROM ret1 JOIN (SELECT symbol, 'SEC' || right(symbol, 1) AS sector FROM universe) USING (symbol)") + f""", {SCO},
vt AS (SELECT symbol, date, {rolling('stddev_samp', 'return_1d', 20)} AS vol FROM ret1),
wd AS (SELECT date, (SELECT max(i) FROM weekdays WHERE d <= date) AS w, isodow(date) <= 5 AS is_weekday FROM (SELECT DISTINCT date FROM panel)),
pd0 AS (SELECT l.order_id, l.sector, l.score AS entry_score, l.shares, l.entry_price, l.entry_value, l.entry_cost, l.target_exit_date, l.fill_date, p.symbol, p.date, p.adj_close AS c,
  max(p.adj_close) OVER (PARTITION BY l.order_id ORDER BY p.date ROWS UNBOUNDED PRECEDING) AS hi, b.w - CAST(a.is_weekday AS INTEGER) - (a.w - CAST(a.is_weekday AS INTEGER)) - CAST(NOT a.is_weekday AS INTEGER) AS held
  FROM ledger l JOIN panel p ON p.symbol = l.symbol AND p.date >= l.fill_date JOIN wd a ON a.date = l.fill_date JOIN wd b ON b.date = p.date WHERE l.status IN ('open', 'closed')),
pd1 AS (SELECT pd0.*, (shares * c - entry_value - entry_cost) / entry_value AS ret, (hi - entry_price) / entry_price >= 0.5 AS armed, c / hi - 1 AS fall, vol, sector_return AS sr, k.score AS cs
  FROM pd0 LEFT JOIN vt USING (symbol, date) LEFT JOIN sr ON sr.sector = pd0.sector AND sr.date = pd0.date LEFT JOIN k ON k.symbol = pd0.symbol AND k.date = pd0.date),
ex AS (SELECT *, CASE WHEN ret <= -0.5 THEN 'stop_loss' WHEN armed AND fall <= -0.5 THEN 'trailing_stop' WHEN armed AND vol IS NOT NULL AND fall <= greatest(least(-vol * 2, -0.03), -0.6) THEN 'trailing_volatility_stop'
   WHEN sr <= -0.2 THEN 'sector_stop' WHEN held >= 5 AND cs IS NOT NULL AND (cs <= 0.005 OR coalesce((entry_score - cs) / nullif(abs(entry_score), 0), 0) >= 0.6) THEN 'score_deterioration' WHEN held >= 10 AND cs <= 0.01 THEN 'rebalance'
   WHEN held >= 2 AND entry_score > 0 AND held >= CAST(trunc(10 * (ln(CASE WHEN entry_score > 0 THEN entry_score END / 0.005) / ln(2))) AS INTEGER) THEN 'time_decay' WHEN date >= target_exit_date THEN 'horizon' END AS reason FROM pd1),
fx AS (SELECT * FROM ex WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY date) = 1),
la AS (SELECT order_id, arg_max(armed, date) AS armed FROM ex GROUP BY order_id)
SELECT l.order_id, CASE WHEN reason IS NULL THEN 'open' ELSE 'closed' END AS status, coalesce(fx.date, l.exit_date) AS exit_date, coalesce(reason, '') AS exit_reason, coalesce(fx.c, l.exit_price) AS exit_price,
 round(CASE WHEN reason IN ('stop_loss', 'horizon') THEN ret WHEN reason LIKE 'trailing%' THEN fall WHEN reason = 'sector_stop' THEN fx.sr WHEN reason IN ('score_deterioration', 'rebalance') THEN cs WHEN reason = 'time_decay' THEN pow(0.5, held / 10.0) ELSE CASE WHEN l.status = 'closed' THEN l.return_pct ELSE 0 END END, 4) + 0.0 AS exit_signal_value,
 CASE WHEN reason IS NULL THEN l.net_pnl ELSE l.shares * fx.c - l.entry_value - l.entry_cost - l.shares * fx.c * 0.001 END AS net_pnl, coalesce(CASE WHEN reason IS NULL THEN la.armed ELSE fx.armed END, false) AS trailing_stop_activated
FROM ledger l LEFT JOIN fx USING (order_id) LEFT JOIN la USING (order_id) WHERE l.status IN ('open', 'closed')""")
HX = """hx AS (SELECT l.*, p.date AS xdate, p.adj_close AS xprice FROM (SELECT *, greatest(target_exit_date, fill_date) AS due FROM ledger) l ASOF LEFT JOIN panel p ON p.symbol = l.symbol AND l.due <= p.date),
l3 AS (SELECT * REPLACE (CASE WHEN status = 'open' AND xdate IS NOT NULL THEN 'closed' ELSE status END AS status, CASE WHEN status = 'open' AND xdate IS NOT NULL THEN 'horizon' ELSE exit_reason END AS exit_reason,
  CASE WHEN status = 'open' AND xdate IS NOT NULL THEN 10 * xprice - entry_value - entry_cost - 10 * xprice * 0.001 ELSE net_pnl END AS net_pnl), status AS was FROM hx)"""
sql("horizon_exits", "ledger", HX + " SELECT account_id, status, exit_reason, count(*) AS orders, round(sum(net_pnl), 2) + 0.0 AS net_pnl FROM l3 GROUP BY 1, 2, 3")
sql("newly_closed_orders", "ledger", HX + " SELECT exit_reason, count(*) AS closed FROM l3 WHERE status = 'closed' AND was <> 'closed' GROUP BY 1")
LAST = "lp AS (SELECT symbol, max(date) AS d, arg_max(adj_close, date) AS p FROM panel GROUP BY symbol)"
sql("position_marks", "ledger scored weekdays", HX + f", {LAST}, {SCO}" + f"""
SELECT l.order_id, l.was AS status, CASE WHEN l.was = 'planned' THEN 'waiting_for_fill' WHEN l.xdate IS NOT NULL THEN 'exit_pending' ELSE 'hold' END AS action, lp.d AS latest_price_date, lp.p AS latest_price,
 CASE WHEN l.was = 'open' THEN 10 * lp.p ELSE 0.0 END AS mark_value, round(CASE WHEN l.was = 'open' THEN 10 * lp.p - entry_value - entry_cost ELSE 0 END, 4) + 0.0 AS unrealized_pnl,
 round(CASE WHEN l.was = 'open' THEN (10 * lp.p - entry_value - entry_cost) / entry_value ELSE 0 END, 4) + 0.0 AS unrealized_return,
 CAST(coalesce((SELECT count(*) FROM weekdays WHERE d BETWEEN l.fill_date AND lp.d) - 1, 0) AS BIGINT) AS days_open, round(CASE WHEN l.was = 'open' THEN k.score END, 4) AS current_score,
 CASE WHEN l.was = 'open' THEN (SELECT max(adj_close) FROM panel q WHERE q.symbol = l.symbol AND q.date >= l.fill_date) ELSE 0.0 END AS highest_close_since_entry
FROM l3 l JOIN lp ON lp.symbol = l.symbol LEFT JOIN k ON k.symbol = l.symbol AND k.date = lp.d WHERE l.was IN ('open', 'planned')""".replace("coalesce((SELECT count(*) FROM weekdays WHERE d BETWEEN l.fill_date AND lp.d) - 1, 0)", "CASE WHEN l.fill_date IS NULL THEN 0 ELSE (SELECT count(*) FROM weekdays WHERE d BETWEEN l.fill_date AND lp.d) - 1 END"))
HELD = f"{LAST}, hd AS (SELECT l.*, (SELECT count(*) FROM weekdays WHERE d BETWEEN l.fill_date AND lp.d) - 1 AS days FROM ledger l JOIN lp USING (symbol) WHERE status = 'open')"
sql("borrow_costs", "ledger weekdays", HELD + " SELECT order_id, round(greatest(entry_value * CASE WHEN symbol IN ('S0000000003', 'S0000000013') THEN 0.5 / 365.0 ELSE 0.03 / 365.0 END * days, 0), 2) AS borrow_cost FROM hd")
sql("dividend_accruals", "ledger weekdays", HELD + " SELECT order_id, round(greatest(entry_value * (0.02 / 365.0) * days, 0), 4) AS dividends FROM hd")
sql("dividend_events", "ledger", """
dv AS (SELECT DISTINCT symbol, CAST(date_trunc('quarter', date) AS DATE) AS ex_date FROM panel)
SELECT l.order_id, round(coalesce((SELECT sum(2.5) FROM dv WHERE dv.symbol = l.symbol AND ex_date >= l.fill_date), 0), 4) AS dividends FROM ledger l WHERE status = 'open'""")
ACC = f"""{LAST}, acc AS (SELECT account_id, 150000.0 - coalesce(sum(entry_value + entry_cost) FILTER (status IN ('open', 'closed')), 0) + coalesce(sum(exit_value - exit_cost) FILTER (status = 'closed'), 0) AS cash,
 coalesce(sum(10 * p) FILTER (status = 'open'), 0) AS marks, coalesce(sum(net_pnl) FILTER (status = 'closed'), 0) AS realized_pnl, coalesce(sum(10 * p - entry_value - entry_cost) FILTER (status = 'open'), 0) AS unrealized_pnl,
 count(*) FILTER (status = 'open') AS open_positions, count(*) FILTER (status = 'closed') AS closed_positions, count(*) FILTER (status = 'planned') AS planned_orders, count(*) FILTER (status = 'skipped') AS skipped_orders
 FROM ledger LEFT JOIN lp USING (symbol) GROUP BY account_id)"""
sql("account_summaries", "ledger", ACC + " SELECT account_id, 150000.0 AS initial_capital, round(cash, 2) AS cash, round(realized_pnl, 2) AS realized_pnl, round(unrealized_pnl, 2) AS unrealized_pnl, open_positions, closed_positions, planned_orders, skipped_orders, round(cash + marks, 2) AS equity FROM acc")
sql("ledger_compaction", "ledger", "SELECT account_id, count(*) AS orders, CASE WHEN status = 'skipped' THEN 'archive' ELSE 'kept' END AS part FROM ledger GROUP BY 1, 3")
sql("open_and_active_symbols", "ledger", "SELECT DISTINCT symbol, 'open' AS kind FROM ledger WHERE status = 'open' UNION ALL SELECT DISTINCT symbol, 'active' FROM ledger WHERE status IN ('open', 'planned')")
AUD = ACC + """, opn AS (SELECT l.account_id, l.symbol, l.sector, 10 * p AS mv, d FROM ledger l JOIN lp USING (symbol) WHERE status = 'open'), mx AS (SELECT max(date) AS m FROM panel),
fnd AS (SELECT account_id, 'ERROR' AS severity, 'negative_cash' AS code, 1 AS n FROM acc WHERE cash + {off} < -0.01
 UNION ALL SELECT account_id, 'ERROR', 'duplicate_active_symbols', 1 FROM ledger WHERE status IN ('open', 'planned') GROUP BY account_id, symbol HAVING count(*) > 1
 UNION ALL SELECT account_id, 'ERROR', 'account_cash_mismatch', 1 FROM acc WHERE abs({off}) > 0.01
 UNION ALL SELECT DISTINCT account_id, 'WARN', 'stale_open_position_prices', hash(symbol) % 1 + 1 FROM (SELECT DISTINCT account_id, symbol FROM opn, mx WHERE d < m) WHERE false
 UNION ALL SELECT account_id, 'WARN', 'stale_open_position_prices', 1 FROM (SELECT DISTINCT account_id, symbol FROM opn, mx WHERE d < m)
 UNION ALL SELECT account_id, 'ERROR', 'non_positive_equity', 1 FROM acc WHERE cash + marks <= 0 AND open_positions > 0
 UNION ALL SELECT account_id, 'WARN', 'gross_exposure_high', 1 FROM acc WHERE cash + marks > 0 AND marks / (cash + marks) > 1
 UNION ALL SELECT account_id, 'WARN', 'sector_exposure_high', 1 FROM opn JOIN acc USING (account_id) WHERE cash + marks > 0 GROUP BY account_id, sector, cash, marks HAVING sum(mv) / (cash + marks) > 0.35
 UNION ALL SELECT account_id, 'WARN', 'stale_planned_orders', 1 FROM ledger, mx WHERE status = 'planned' AND (SELECT count(*) FROM weekdays WHERE d BETWEEN planned_date AND m) - 1 > 2
 UNION ALL SELECT DISTINCT account_id, 'WARN', 'stale_price_file', 1 FROM ledger, mx WHERE datediff('day', m, DATE '{day}') > 3)"""
AUD = AUD.replace(""" UNION ALL SELECT DISTINCT account_id, 'WARN', 'stale_open_position_prices', hash(symbol) % 1 + 1 FROM (SELECT DISTINCT account_id, symbol FROM opn, mx WHERE d < m) WHERE false
""", "")
sql("audit_findings", "ledger weekdays", AUD.replace("{off}", "(CAST(right(account_id, 1) AS DOUBLE) - 3.0)").replace("{day}", "2001-11-20") + " SELECT account_id, severity, code, count(*) AS findings FROM fnd GROUP BY 1, 2, 3")
sql("audit_summary", "ledger weekdays", AUD.replace("{off}", "0").replace("{day}", "2001-11-05") + """ SELECT a.account_id, count(DISTINCT code) FILTER (severity = 'ERROR') AS errors, count(DISTINCT code) FILTER (severity = 'WARN') AS warnings,
 CASE WHEN count(DISTINCT code) FILTER (severity = 'ERROR') > 0 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT DISTINCT account_id FROM ledger) a LEFT JOIN fnd USING (account_id) GROUP BY a.account_id""")
sql("monitor_summary", "ledger", HX + """ SELECT account_id, nullif(count(*) FILTER (was = 'open' AND xdate IS NULL), 0) AS hold, nullif(count(*) FILTER (was = 'open' AND xdate IS NOT NULL), 0) AS exit_pending, count(*) FILTER (was = 'planned') AS waiting,
 CAST(count(DISTINCT sector) FILTER (was = 'open') AS INTEGER) AS sectors, count(*) FILTER (was = 'closed' AND exit_date = DATE '1999-06-15') AS closed_today FROM l3 GROUP BY account_id""")
sql("next_horizon_exits", "ledger", "SELECT account_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY target_exit_date, symbol, order_id) AS INTEGER) AS rank, symbol, target_exit_date FROM ledger WHERE status = 'open' QUALIFY rank <= 5")
sql("tracking_summary", "ledger", """
runs AS (SELECT account_id, strftime(exit_date, '%Y-%m') AS local_time, 2000.0 + sum(shares) AS eq, sum(shares) AS cash, count(*) FILTER (net_pnl < -20000) AS err, count(*) AS warn FROM ledger WHERE status = 'closed' GROUP BY 1, 2),
a AS (SELECT account_id, count(*) AS history_rows, min(local_time) AS first_snapshot, max(local_time) AS latest_snapshot, arg_max(eq, local_time) AS paper_equity, max(eq) AS paper_peak_equity, arg_max(cash, local_time) AS paper_cash, CAST(sum(err) AS BIGINT) AS audit_errors, CAST(sum(warn) AS BIGINT) AS audit_warnings FROM runs GROUP BY 1),
b AS (SELECT account_id, count(*) FILTER (status = 'open') AS open_positions, count(*) FILTER (status = 'closed') AS closed_positions, round(avg(CAST(net_pnl > 0 AS DOUBLE)) FILTER (status = 'closed'), 6) AS closed_win_rate FROM ledger GROUP BY 1)
SELECT *, round(paper_equity / 2000 - 1, 6) AS paper_total_return, round(paper_equity / paper_peak_equity - 1, 6) AS paper_current_drawdown,
 CASE WHEN audit_errors > 0 THEN 'fix realism issues before interpreting performance' WHEN closed_positions < 10 THEN 'too early for performance judgment' ELSE 'ready for paper-vs-backtest comparison' END AS assessment FROM a JOIN b USING (account_id)""")

# --- monitoring -------------------------------------------------------------------------------------
PREV = """prev AS (SELECT symbol, DATE '1999-06-15' - CAST(n % 9 AS INTEGER) AS first_seen, CAST(n % 5 + 1 AS INTEGER) AS appearances, 40.0 + n % 30 AS latest, 45.0 + n % 30 AS best FROM (SELECT symbol, CAST(right(symbol, 3) AS INTEGER) AS n FROM universe) WHERE n % 3 <> 0)"""
MON = WL + f""", {PREV}, mem AS (SELECT symbol, string_agg(lane, ', ' ORDER BY lane) AS lm, CAST(count(*) AS INTEGER) AS lc FROM wl GROUP BY symbol),
m0 AS (SELECT s.symbol, s.sector, s.discovery_score, coalesce(lm, '') AS lanes_matched, coalesce(lc, 0) AS lane_count, coalesce(p.first_seen, DATE '1999-06-15') AS first_seen, CAST(coalesce(p.appearances, 0) + 1 AS INTEGER) AS appearances,
  CAST(greatest(0, DATE '1999-06-15' - coalesce(p.first_seen, DATE '1999-06-15')) AS INTEGER) AS age FROM sco s LEFT JOIN mem USING (symbol) LEFT JOIN prev p USING (symbol)),
m1_ AS (SELECT *, concat_ws('; ', CASE WHEN symbol LIKE '%5' AND symbol IN (SELECT symbol FROM ledger WHERE status = 'open') THEN 'already_active_in_paper' END, CASE WHEN symbol LIKE '%4' THEN 'already_tracked' END,
  CASE WHEN age < 5 THEN 'monitoring_age_below_5_days' END, CASE WHEN appearances < 3 THEN 'appearances_below_3' END, CASE WHEN discovery_score < 50 THEN 'discovery_score_below_50' END) AS blockers FROM m0),
mon AS (SELECT *, CASE WHEN blockers = '' THEN 'eligible_for_review' ELSE 'monitoring' END AS status FROM m1_)"""
MUSES = USES + " ledger"
sql("monitoring_candidates", MUSES, MON + " SELECT symbol, round(discovery_score, 6) AS discovery_score, lanes_matched, lane_count, first_seen, appearances, age AS monitoring_age_days, blockers AS promotion_blockers, status AS promotion_status FROM mon")
sql("monitoring_state", MUSES, MON + """ SELECT coalesce(m.symbol, p.symbol) AS symbol, coalesce(m.first_seen, p.first_seen) AS first_seen, CASE WHEN m.symbol IS NULL THEN DATE '1999-06-14' ELSE DATE '1999-06-15' END AS last_seen, coalesce(m.appearances, p.appearances) AS appearances,
 round(coalesce(m.discovery_score, p.latest), 6) AS latest_discovery_score, round(CASE WHEN m.symbol IS NULL THEN p.best ELSE greatest(coalesce(p.best, 0), m.discovery_score) END, 6) AS max_discovery_score, coalesce(m.status, 'monitoring') AS promotion_status FROM mon m FULL JOIN prev p ON p.symbol = m.symbol""")
sql("monitoring_summary", MUSES, MON + " SELECT (SELECT count(DISTINCT symbol) FROM universe) AS source_universe_count, (SELECT count(*) FROM sco) AS eligible_after_filters, count(*) AS monitored_candidate_count, count(*) FILTER (status = 'eligible_for_review') AS promotion_candidate_count FROM mon")


def promotion(sector: str, min_appearances: int) -> str:
    return MON + f""", pp AS (SELECT *, concat_ws('; ', CASE WHEN status <> 'eligible_for_review' THEN 'not_eligible_for_review' END, CASE WHEN symbol LIKE '%7' THEN 'already_tracked' END, CASE WHEN discovery_score < 45 THEN 'discovery_score_below_45' END,
  CASE WHEN appearances < {min_appearances} THEN 'appearances_below_{min_appearances}' END) AS b FROM mon),
p2 AS (SELECT *, row_number() OVER (PARTITION BY b = '', sector ORDER BY discovery_score DESC, symbol) AS ins FROM pp),
p3 AS (SELECT *, CASE WHEN b <> '' THEN b WHEN {sector} THEN 'max_sector_symbols_1' ELSE '' END AS b2 FROM p2),
p4 AS (SELECT *, CASE WHEN b2 = '' AND row_number() OVER (PARTITION BY b2 = '' ORDER BY discovery_score DESC, symbol) > 4 THEN 'max_symbols_limit_4' ELSE b2 END AS b3 FROM p3)"""


sql("promotion_plan", MUSES, promotion("ins > 1", 1) + """ SELECT symbol, sector, printf('Promoted from symbol discovery monitoring; score=%.2f', discovery_score) || CASE WHEN lanes_matched <> '' THEN '; lanes=' || lanes_matched ELSE '' END AS notes,
 CASE WHEN b3 = '' THEN 'ready_to_promote' ELSE 'blocked' END AS promotion_plan_status, b3 AS promotion_plan_blockers FROM p4""")
sql("promotion_summary", MUSES, promotion("false", 0) + " SELECT count(*) AS candidate_count, count(*) FILTER (b3 = '') AS ready_to_promote_count, count(*) FILTER (b3 <> '') AS blocked_count, coalesce(string_agg(symbol, ', ' ORDER BY symbol) FILTER (b3 = ''), '') AS ready_symbols FROM p4")

# --- reports ----------------------------------------------------------------------------------------
BUCKET = """ok AS (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY score, date, symbol) AS i, count(*) OVER (PARTITION BY split_id) AS n FROM scored WHERE score IS NOT NULL AND forward_return IS NOT NULL),
bk AS (SELECT *, CAST(greatest(1, ceil((i - 1) * 10.0 / (n - 1))) AS INTEGER) AS score_bucket FROM ok),
br AS (SELECT *, rank() OVER (PARTITION BY split_id, score_bucket ORDER BY score) + (count(*) OVER (PARTITION BY split_id, score_bucket, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY split_id, score_bucket ORDER BY forward_return) + (count(*) OVER (PARTITION BY split_id, score_bucket, forward_return) - 1) / 2.0 AS b FROM bk),
bt AS (SELECT split_id, score_bucket, count(*) AS rows, min(score) AS score_min, avg(score) AS score_mean, max(score) AS score_max, avg(forward_return) AS m, avg(CAST(forward_return > 0 AS DOUBLE)) AS win_rate, corr(a, b) AS ic FROM br GROUP BY 1, 2)"""
sql("score_buckets", "scored", BUCKET + """ SELECT split_id, score_bucket, rows, score_min, round(score_mean, 6) AS score_mean, score_max, round(m, 6) AS mean_target, round(m, 6) AS mean_realized_return, round(win_rate, 6) AS win_rate,
 CASE score_bucket WHEN 10 THEN 'highest' WHEN 1 THEN 'lowest' ELSE '' END AS bucket_label, round(ic, 6) + 0.0 AS ic_spearman FROM bt""")
sql("score_bucket_overview", "scored", BUCKET + " SELECT score_bucket, round(avg(m), 6) AS mean_realized_return, round(avg(win_rate), 6) AS win_rate, CAST(sum(rows) AS BIGINT) AS rows FROM bt GROUP BY 1")
sql("prediction_drift", "scored bench", MARKET + """ SELECT strftime(date, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT symbol) AS symbols, round(avg(score), 6) + 0.0 AS score_mean, round(stddev_samp(score), 6) AS score_std, count(*) FILTER (score >= 0.01) AS above_threshold,
 round(avg(m20), 6) + 0.0 AS market_return_20d, round(avg(m60), 6) + 0.0 AS market_return_60d, round(quantile_cont(score, 0.1), 6) + 0.0 AS score_p10, round(quantile_cont(score, 0.5), 6) + 0.0 AS score_p50, round(quantile_cont(score, 0.9), 6) + 0.0 AS score_p90
 FROM scored LEFT JOIN market USING (date) WHERE score IS NOT NULL GROUP BY 1""")
sql("sector_contribution", "ledger universe", "SELECT u.sector, count(*) AS trades, count(DISTINCT l.symbol) AS symbols, round(sum(net_pnl), 2) + 0.0 AS net_pnl, round(avg(net_pnl), 2) + 0.0 AS avg_net_pnl, round(avg(CAST(net_pnl > 0 AS DOUBLE)), 6) AS win_rate, round(sum(entry_value), 2) AS gross_entry_value FROM ledger l LEFT JOIN universe u USING (symbol) WHERE status = 'closed' GROUP BY 1")
sql("attached_reference", "scored universe", f"rt AS (SELECT symbol, date, adj_close / {lag('adj_close')} - 1 AS x FROM panel), v AS (SELECT symbol, date, {rolling('stddev_samp', 'x', 20)} AS vol FROM rt) SELECT date, symbol, score, sector, round(vol, 6) AS volatility_20d FROM scored LEFT JOIN universe USING (symbol) LEFT JOIN v USING (symbol, date)")
sql("quantile_buckets_per_date", "scored", """SELECT date, symbol, score, CAST(greatest(1, ceil(coalesce((row_number() OVER w - 1) * 5.0 / nullif(count(*) OVER (PARTITION BY date) - 1, 0), 0))) AS INTEGER) AS bucket FROM scored WHERE score IS NOT NULL WINDOW w AS (PARTITION BY date ORDER BY score, symbol)""")
sql("top_rows", "scored", "SELECT date, symbol, score FROM scored QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, symbol) <= 10")
sql("order_explanations", "scored", FULL + f""", f AS (SELECT * FROM full1), q AS (SELECT symbol, date, r20, v20, {pct_rank('r20', 'date')} AS p20, {pct_rank('v20', 'date')} AS pv FROM f),
lg AS (SELECT date, symbol, 'return_20d' AS feature, r20 AS value, p20 AS percentile FROM q UNION ALL SELECT date, symbol, 'volatility_20d', v20, pv FROM q)
SELECT s.date, s.symbol, s.score, 'planned' AS status, feature, round(value, 6) AS value, round(percentile, 6) AS percentile FROM scored s JOIN lg USING (date, symbol) WHERE s.score > 0""")
BLEND = f"""b0 AS (SELECT year(date) - 1994 AS split_id, symbol, date, adj_close / {lag('adj_close', 5)} - 1 AS a, adj_close / {lag('adj_close', 10)} - 1 AS b, adj_close / {lag('adj_close', 20)} - 1 AS c FROM panel),
b1 AS (SELECT *, list_median([a, b, c]) AS m FROM b0 WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
cw AS (SELECT split_id, greatest(corr(a, m), 0) AS wa, greatest(corr(b, m), 0) AS wb, greatest(corr(c, m), 0) AS wc FROM b1 GROUP BY 1)"""
sql("consensus_blend", "panel", BLEND + " SELECT split_id, date, symbol, round((a * wa + b * wb + c * wc) / (wa + wb + wc), 6) + 0.0 AS weighted, round((a + b + c) / 3, 6) + 0.0 AS average FROM b1 JOIN cw USING (split_id)")
FOLDS = """fl AS (SELECT CAST(DATE '{start}' + INTERVAL ({months} * k) MONTH AS DATE) AS vs, CAST(DATE '{start}' + INTERVAL ({months} * (k + 1)) MONTH - INTERVAL 1 DAY AS DATE) AS ve FROM range(0, 40) t(k)),
fo AS (SELECT row_number() OVER (ORDER BY vs) AS split_id, vs - {gap} AS te, vs, ve FROM fl WHERE ve <= (SELECT max(date) FROM {rows}))"""
sql("walk_forward_folds", "scored", FOLDS.format(start="1997-01-01", months=6, gap=6, rows="scored") + """ SELECT DATE '1995-01-01' AS train_start, te AS train_end, vs AS validation_start, ve AS validation_end, count(*) FILTER (date <= te) AS train_rows,
 count(*) FILTER (date BETWEEN vs AND ve) AS validation_rows, CAST(fo.split_id AS INTEGER) AS split_id FROM fo, scored WHERE date >= DATE '1995-01-01' GROUP BY te, vs, ve, fo.split_id""")
sql("ridge_walk_forward_single_feature", "scored", "ok AS (SELECT date, symbol, score AS x, forward_return AS y FROM scored WHERE score IS NOT NULL AND forward_return IS NOT NULL), " + FOLDS.format(start="1998-01-01", months=12, gap=8, rows="ok") + """,
fit AS (SELECT split_id, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n, covar_pop(x, y) AS c FROM fo JOIN ok ON date BETWEEN DATE '1995-01-01' AND te GROUP BY 1)
SELECT CAST(split_id AS INTEGER) AS split_id, date, symbol, round(my + (x - mx) / sx * (n * c / sx) / (n + 25.0), 6) + 0.0 AS prediction FROM fo JOIN fit USING (split_id) JOIN ok ON date BETWEEN vs AND ve""")


def two_features(gap: int) -> str:
    """Rows of both feature sets, folds and the moments of every training window, unfolded from the definition of covariance."""
    return f"""two AS (SELECT date, symbol, score, score AS x1, ln(1 + avg_dollar_volume_20d) AS x2, forward_return AS y FROM scored WHERE score IS NOT NULL AND forward_return IS NOT NULL),
ok AS (SELECT * FROM two WHERE x2 IS NOT NULL), {FOLDS.format(start="1998-01-01", months=12, gap=gap, rows="ok")},
m2 AS (SELECT split_id, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS rho, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM fo JOIN ok ON date BETWEEN DATE '1995-01-01' AND te GROUP BY 1),
m1 AS (SELECT split_id, count(*) AS n, avg(x1) AS m1, avg(y) AS my, stddev_pop(x1) AS s1, covar_pop(x1, y) AS c1 FROM fo JOIN two ON date BETWEEN DATE '1995-01-01' AND te GROUP BY 1)"""


def both(alpha: str) -> str:
    """Weights of the two standardised features by Cramer's rule."""
    det = f"((n + {alpha}) * (n + {alpha}) - n * rho * n * rho)"
    return f"((n + {alpha}) * n * c1 / s1 - n * rho * n * c2 / s2) / {det} AS b1, ((n + {alpha}) * n * c2 / s2 - n * rho * n * c1 / s1) / {det} AS b2"


sql("ridge_grid_predictions", "scored", two_features(8) + f""",
w AS (SELECT t.trial, m2.*, {both('t.alpha')} FROM m2, (VALUES (0, 10.0), (1, 20000.0)) t(trial, alpha))
SELECT trial, CAST(split_id AS INTEGER) AS split_id, date, symbol, round(my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2, 6) + 0.0 AS prediction FROM fo JOIN w USING (split_id) JOIN ok ON date BETWEEN vs AND ve
UNION ALL SELECT 2, CAST(split_id AS INTEGER), date, symbol, round(my + (x1 - m1) / s1 * (n * c1 / s1) / (n + 20000.0), 6) + 0.0 FROM fo JOIN m1 USING (split_id) JOIN two ON date BETWEEN vs AND ve""")
sql("ridge_walk_forward_two_features", "scored", two_features(8) + f""",
w AS (SELECT *, {both('500.0')} FROM m2)
SELECT CAST(split_id AS INTEGER) AS split_id, date, symbol, round(my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2, 6) + 0.0 AS prediction,
 round(abs(b1) * sqrt(n / (n - 1.0)), 6) + 0.0 AS importance_x1, round(abs(b2) * sqrt(n / (n - 1.0)), 6) + 0.0 AS importance_x2 FROM fo JOIN w USING (split_id) JOIN ok ON date BETWEEN vs AND ve""")


def trial_days(predictions: str, score: str = "p", name: str = "daily") -> str:
    """Net return per trial, split and date of tenths by ``score`` of the table ``predictions`` (trial, split_id, date, symbol, y, ...)."""
    return f"""
{name}_r AS (SELECT *, count(*) OVER g AS n_day, row_number() OVER (g ORDER BY {score} DESC, symbol) AS hi, row_number() OVER (g ORDER BY {score}, symbol) AS lo FROM {predictions} WHERE {score} IS NOT NULL WINDOW g AS (PARTITION BY trial, split_id, date)),
{name}_k AS (SELECT *, greatest(1, CAST(floor(n_day * 0.1) AS INTEGER)) AS k FROM {name}_r),
{name} AS (SELECT trial, split_id, date, sum(CASE WHEN hi <= k THEN least(1.0 / k, 0.02) * y ELSE 0 END - CASE WHEN lo <= k THEN least(1.0 / k, 0.02) * y ELSE 0 END)
  - 0.001 * sum(CASE WHEN hi <= k THEN least(1.0 / k, 0.02) ELSE 0 END + CASE WHEN lo <= k THEN least(1.0 / k, 0.02) ELSE 0 END) AS net FROM {name}_k GROUP BY 1, 2, 3)"""


sql("ridge_grid_search", "scored", two_features(8) + f""",
a AS (SELECT CAST(row_number() OVER (ORDER BY alpha) - 1 AS INTEGER) AS trial, CAST(alpha AS DOUBLE) AS alpha FROM (VALUES (0.001), (0.01), (0.1), (1.0), (10.0), (100.0), (1000.0)) t(alpha)),
w AS (SELECT trial, m2.*, {both('a.alpha')} FROM m2, a),
pr AS (SELECT trial, split_id, date, symbol, y, my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2 AS p FROM fo JOIN w USING (split_id) JOIN ok ON date BETWEEN vs AND ve),""" + trial_days("pr") + """,
sh AS (SELECT trial, split_id, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) AS s FROM daily GROUP BY 1, 2)
SELECT trial AS number, round(avg(s), 6) + 0.0 AS value, 'COMPLETE' AS state, any_value(alpha) AS alpha FROM sh JOIN a USING (trial) GROUP BY trial""")
sql("two_set_leaderboard", "scored", two_features(6) + f""",
w AS (SELECT *, {both('50.0')} FROM m2),
pr AS (SELECT 1 AS trial, split_id, date, symbol, score, y, my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2 AS p FROM fo JOIN w USING (split_id) JOIN ok ON date BETWEEN vs AND ve
  UNION ALL SELECT 0, split_id, date, symbol, score, y, my + (x1 - m1) / s1 * (n * c1 / s1) / (n + 50.0) FROM fo JOIN m1 USING (split_id) JOIN two ON date BETWEEN vs AND ve),
rk AS (SELECT *, rank() OVER (PARTITION BY trial, split_id ORDER BY p) + (count(*) OVER (PARTITION BY trial, split_id, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY trial, split_id ORDER BY y) + (count(*) OVER (PARTITION BY trial, split_id, y) - 1) / 2.0 AS ry FROM pr),
ic AS (SELECT trial, split_id, count(*) AS n_rows, corr(rp, ry) AS ic, avg(CAST((p > 0) = (y > 0) AS DOUBLE)) AS hits FROM rk GROUP BY 1, 2),""" + trial_days("pr") + "," + trial_days("pr", "score", "bench") + """,
eq AS (SELECT *, product(1 + net) OVER (PARTITION BY trial, split_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM daily),
dd AS (SELECT *, e / max(e) OVER (PARTITION BY trial, split_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM eq),
st AS (SELECT trial, split_id, avg(net) AS mean, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) AS sharpe, min(fall) AS fall, count(*) AS days FROM dd GROUP BY 1, 2),
bs AS (SELECT trial, split_id, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) AS sharpe FROM bench GROUP BY 1, 2)
SELECT CASE trial WHEN 0 THEN 'ridge_one_5d' ELSE 'ridge_two_5d' END AS experiment, 5 AS horizon, CASE trial WHEN 0 THEN 'one' ELSE 'two' END AS feature_set, 'ridge' AS model, 'ridge' AS model_type, 'close_excess' AS target_kind,
 count(*) AS split_count, CAST(sum(n_rows) AS BIGINT) AS prediction_count, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_std, count(*) FILTER (ic > 0) AS positive_ic_splits, round(avg(hits), 6) AS directional_hit_rate,
 round(avg(mean), 6) + 0.0 AS backtest_mean_daily_return, round(avg(st.sharpe), 6) + 0.0 AS backtest_sharpe, round(min(fall), 6) + 0.0 AS backtest_max_drawdown, round(avg(mean), 6) + 0.0 AS risk_backtest_mean_daily_return,
 round(avg(st.sharpe), 6) + 0.0 AS risk_backtest_sharpe, round(min(fall), 6) + 0.0 AS risk_backtest_max_drawdown, round(avg(days), 6) AS risk_backtest_avg_trading_days, round(avg(bs.sharpe), 6) + 0.0 AS benchmark_sharpe, round(avg(bs.sharpe), 6) + 0.0 AS benchmark_risk_sharpe
FROM ic JOIN st USING (trial, split_id) JOIN bs USING (trial, split_id) GROUP BY trial""")
sql("scored_as_of", "scored", f"""kn AS (SELECT score AS x1, ln(1 + avg_dollar_volume_20d) AS x2, forward_return AS y FROM scored WHERE date <= DATE '2000-06-08' AND score IS NOT NULL AND avg_dollar_volume_20d IS NOT NULL AND forward_return IS NOT NULL),
mo AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS rho, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM kn),
w AS (SELECT *, {both('30.0')} FROM mo)
SELECT date, symbol, round(my + b1 * (score - m1) / s1 + b2 * (ln(1 + avg_dollar_volume_20d) - m2) / s2, 6) + 0.0 AS score, round(score, 6) AS x1 FROM scored, w WHERE date = DATE '2000-06-15' AND score IS NOT NULL AND avg_dollar_volume_20d IS NOT NULL""")
sql("single_split_trees", "scored", """cal AS (SELECT date, symbol, forward_return AS y, CAST(month(date) AS DOUBLE) AS x1, CAST(isodow(date) - 1 AS DOUBLE) AS x2 FROM scored WHERE forward_return IS NOT NULL), """
    + FOLDS.format(start="1998-01-01", months=12, gap=8, rows="cal") + """,
tr AS (SELECT split_id, x1, x2, y FROM fo JOIN cal ON date BETWEEN DATE '1995-01-01' AND te),
lv AS (SELECT split_id, 1 AS f, x1 AS x, count(*) AS n, sum(y) AS s FROM tr GROUP BY 1, 3 UNION ALL SELECT split_id, 2, x2, count(*), sum(y) FROM tr GROUP BY 1, 3),
pf AS (SELECT *, sum(n) OVER a AS nl, sum(s) OVER a AS sl, sum(n) OVER b AS na, sum(s) OVER b AS sa, lead(x) OVER a AS nx FROM lv WINDOW a AS (PARTITION BY split_id, f ORDER BY x), b AS (PARTITION BY split_id, f)),
best AS (SELECT * FROM pf WHERE nx IS NOT NULL AND nl >= 25 AND na - nl >= 25 QUALIFY row_number() OVER (PARTITION BY split_id ORDER BY sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) DESC) = 1)
SELECT CAST(split_id AS INTEGER) AS split_id, date, symbol, round(CASE WHEN CASE f WHEN 1 THEN x1 ELSE x2 END <= x THEN sl / nl ELSE (sa - sl) / (na - nl) END, 6) + 0.0 AS prediction FROM fo JOIN best USING (split_id) JOIN cal ON date BETWEEN vs AND ve""")
AUDIT = two_features(6) + f""",
w AS (SELECT *, {both('50.0')} FROM m2),
pr AS (SELECT 0 AS trial, split_id, date, symbol, y, my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2 AS p FROM fo JOIN w USING (split_id) JOIN ok ON date BETWEEN vs AND ve),""" + trial_days("pr")
sql("experiment_audit_daily", "scored", AUDIT + """
SELECT CAST(split_id AS INTEGER) AS split_id, date, round(net, 6) + 0.0 AS net_return, round(sign(e) * ln(abs(e)), 6) + 0.0 AS log_raw_equity, round(sign(e) * ln(abs(e)), 6) + 0.0 AS log_risk_equity_full
FROM (SELECT *, product(1 + net) OVER (ORDER BY split_id, date ROWS UNBOUNDED PRECEDING) AS e FROM daily)""")
sql("experiment_audit_monthly", "scored", AUDIT + " SELECT strftime(date, '%Y-%m') AS month, round(product(1 + net) - 1, 6) + 0.0 AS raw_return, round(product(1 + net) - 1, 6) + 0.0 AS risk_return, count(*) AS trading_days FROM daily GROUP BY 1")
sql("experiment_audit_symbols", "scored", AUDIT + """,
held AS (SELECT symbol, 'long' AS side, least(1.0 / k, 0.02) AS weight, y FROM daily_k WHERE hi <= k UNION ALL SELECT symbol, 'short', -least(1.0 / k, 0.02), y FROM daily_k WHERE lo <= k)
SELECT symbol, count(*) FILTER (side = 'long') AS long_days, count(*) FILTER (side = 'short') AS short_days, round(sum(weight * y), 6) + 0.0 AS gross_contribution,
 round(avg(weight * y), 6) + 0.0 AS avg_daily_contribution, round(avg(abs(weight)), 6) AS avg_abs_weight FROM held GROUP BY symbol""")
sql("summary_comparison", "scored", positions() + ", t1 AS (SELECT split_id, avg(net_return) AS a, avg(gross_exposure) AS b FROM daily GROUP BY 1)" + positions(0.2).replace("\nsr AS", ",\nsr2 AS").replace("FROM sr)", "FROM sr2)").replace("sk AS", "sk2 AS").replace("FROM sk ", "FROM sk2 ").replace("pos AS", "pos2 AS").replace("daily AS", "daily2 AS").replace("FROM pos ", "FROM pos2 ") + """,
t2 AS (SELECT split_id, avg(net_return) AS a, avg(gross_exposure) AS b FROM daily2 GROUP BY 1)
SELECT 'tenth' AS model, round(avg(a), 6) + 0.0 AS mean_net_return, round(avg(b), 6) AS mean_gross_exposure FROM t1 UNION ALL SELECT 'fifth', round(avg(a), 6) + 0.0, round(avg(b), 6) FROM t2""")
