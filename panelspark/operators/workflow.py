"""Discovery, lane evaluation and portfolio evaluation as one call with one summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import discovery, lanes, portfolio
from panelspark.session import cut_lineage

STAGES = ("discovery", "lane_backtest", "portfolio_backtest")


@dataclass
class WorkflowResult:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """One row per stage: its status and the rows of its main table; counted where it is read."""
        main = dict(zip(STAGES, ("candidates", "trades", "daily_returns")))
        out = None
        for stage in STAGES:
            if self.status[stage] == "completed":
                row = self.tables[f"{stage}.{main[stage]}"].agg(F.count("*").alias("rows"))
            else:
                row = next(iter(self.tables.values())).sparkSession.range(1).select(F.lit(0).cast("long").alias("rows")) if self.tables else None
            if row is not None:
                row = row.select(F.lit(stage).alias("stage"), F.lit(self.status[stage]).alias("status"), "rows")
                out = row if out is None else out.unionByName(row)
        return out


def run_workflow(
    frame: DataFrame, prices: DataFrame, *, as_of_date, rebalance: str = "monthly", skip=(), snapshot: DataFrame | None = None, trades: DataFrame | None = None,
    watchlist: DataFrame | None = None, discovery_config: discovery.DiscoveryConfig | None = None, portfolio_config: portfolio.PortfolioConfig | None = None,
    top_n: int = 25, horizons=(5, 20, 60),
) -> WorkflowResult:
    """Run the stages that are not in ``skip``, each on what the stage before it made.

    ``frame`` is the enriched panel; ``snapshot`` may hold its rows of ``as_of_date`` alone, so that discovery does not compute other
    dates. Without the lane stage the portfolio needs ``trades``. Tables are named ``stage.table``; nothing runs until they are read,
    but for what the stages store.
    """
    unknown = set(skip) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    result = WorkflowResult(status={s: "skipped" if s in skip else "completed" for s in STAGES})

    def keep(stage, tables):
        result.tables.update({f"{stage}.{name}": table for name, table in tables.items()})

    if "discovery" not in skip:
        keep("discovery", discovery.run_discovery(frame if snapshot is None else snapshot, watchlist=watchlist, config=discovery_config, as_of_date=as_of_date, within=prices))
    if "lane_backtest" not in skip:
        dates = lanes.rebalance_dates(prices, rebalance)
        trades = lanes.lane_backtest(frame, dates, config=discovery_config, top_n=top_n, horizons=horizons, watchlist=watchlist, within=prices)
        trades = cut_lineage(trades)  # a few rows per lane and date, read by the summary and several times by the portfolio
        keep("lane_backtest", {"trades": trades, "summary": lanes.lane_summary(trades, horizons)})
    if "portfolio_backtest" not in skip:
        if trades is None:
            raise ValueError("the portfolio needs the lane stage or trades")
        made = portfolio.run_portfolio(trades, prices, portfolio_config)
        keep("portfolio_backtest", {**made, "summary": portfolio.portfolio_summary(made, portfolio_config)})
    return result
