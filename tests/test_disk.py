"""Queries must shuffle and store no more than their result needs, with the results of the plain way."""

import random
import re

from pyspark.sql import functions as F

from panelspark.functions import crosssection as cs
from panelspark.operators import asof, fundamentals, lanes
from panelspark.plans import queries_evaluation as q
from panelspark.plans.fixtures import Inputs

SF = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*(names or sorted(df.columns))).collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def panel(spark, seed=1, symbols=9):
    """Rows on some days of 150, of symbols with gaps of months, one of them null."""
    draw = random.Random(seed)
    out = [(s, d, draw.random(), draw.randrange(4)) for s in ["a", "b", None, *map(str, range(symbols))] for d in range(150) if draw.random() < (0.02 if s in ("a", None) else 0.3)]
    return spark.createDataFrame(out, "symbol string, d int, x double, g int").select("symbol", F.date_add(F.lit("2020-01-01").cast("date"), "d").alias("date"), "x", "g")


# --- F3, F4, F5, F7 -----------------------------------------------------------------------------------


def test_marked_rows_are_the_latest_ones(spark):
    p = panel(spark)
    dates = lanes.rebalance_dates(p, "monthly", end="2020-04-20")
    marked = asof.mark_latest(p, dates, p.select("date").distinct())
    assert marked.count() == p.count()
    want = rows(asof.latest_rows_at(p, dates), "as_of_date", "symbol", "date", "x")
    assert len(want) > 20 and rows(asof.spread_latest(marked, dates), "as_of_date", "symbol", "date", "x") == want
    # also where days on which no row is a latest one are gone
    some = p.join(lanes.needed_dates(p, dates), "date", "left_semi")
    assert rows(asof.spread_latest(asof.mark_latest(some, dates, p.select("date")), dates), "as_of_date", "symbol", "date", "x") == want
    # and their places are found without a shuffle of rows that lie by symbol
    dealt = asof.mark_latest(p.repartition(4, "symbol"), dates, p.select("date"))
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", plan(dealt))) == 1 == len(re.findall(r"REPARTITION_BY_NUM", plan(dealt)))


def test_ranks_of_chosen_rows(spark):
    p = panel(spark).withColumns({"chosen": F.col("x") > 0.4, "note": F.concat(F.lit("n"), F.col("x").cast("string"))})
    ranks, stats = {"r": ("x", True), "s": ("x", False)}, {"m": F.max("x")}
    names = ["symbol", "date", "g", "x", "note", "r", "s", "m"]
    want = rows(cs.with_percent_ranks(p, ["date", "g"], ranks, stats=stats).filter("chosen"), *names)
    assert want
    for whole in (100, 2):  # groups in tasks, and some that are too large for one
        for deal in (None, (["date"], p.select("date"))):
            for packed in (False, True):
                out = cs.with_percent_ranks(p, ["date", "g"], ranks, stats=stats, whole=whole, packed=packed, only="chosen", deal=deal)
                assert rows(out, *names) == want


def test_lane_trades_are_those_of_the_whole_frame(spark):
    i = Inputs(spark, SF)
    dates = lanes.rebalance_dates(i.prices(), "monthly")
    frame = q.discovery_frame(i, lanes.needed_dates(i.prices(), dates), (5, 20, 60))
    plain = lanes.lane_backtest(frame, dates, config=q.DISCOVERY, top_n=5, watchlist=q.watched(i))
    names = ["as_of_date", "symbol", "lane", "rank", "selection_price", "forward_price_20d"]
    want = rows(plain, *names)
    assert rows(q.lane_trades(i), *names) == want
    # only candidates are carried beyond the ranks
    assert q.lane_frame(i, dates).count() < frame.count() / 2


# --- F8 to F15 ----------------------------------------------------------------------------------------


def test_a_symbols_history_takes_one_shuffle(spark):
    i = Inputs(spark, SF)
    for df in (i.prices(), i.scored(), i.ledger()):
        assert len(re.findall(r"Exchange ", plan(df))) == 1


def test_fundamentals_come_to_the_panel(spark):
    i = Inputs(spark, SF)
    table = fundamentals.normalize_fundamentals(i.fundamentals())
    out = fundamentals.enrich_with_fundamentals(i.prices(), table, keyed=True)
    assert "Exchange" not in plan(out).split("Union")[0]
    assert rows(out, "symbol", "date", "market_cap", "close") == rows(fundamentals.enrich_with_fundamentals(i.prices(), table), "symbol", "date", "market_cap", "close")


def test_scores_of_all_dates_are_those_of_the_whole_frame(spark):
    from panelspark.operators import discovery

    i = Inputs(spark, SF)
    kept, _ = discovery.filter_candidates(q.discovery_frame(i), q.DISCOVERY, q.watched(i))
    names = ["date", "symbol", *(F.round(c, 6).alias(c) for c in q.SCORES)]
    want = rows(discovery.score_candidates(kept, q.DISCOVERY, ["date"]).withColumns({c: F.col(c) + 1e-9 for c in q.SCORES}), *names)
    from panelspark.plans.registry import QUERIES

    out = QUERIES["discovery_scores_all_dates"](spark, SF)
    assert rows(out, *names) == want
    shuffled = re.findall(r"Exchange hashpartitioning\((?:date|sector)[^\n]*", plan(out))
    assert len(shuffled) == 1, shuffled  # rows of a date come together once, for sectors and scores


# --- F10, F11, F12, F14 -------------------------------------------------------------------------------


def test_a_model_frame_takes_one_shuffle(spark):
    from panelspark.operators import features

    i = Inputs(spark, SF)
    frame = q.model_frame(i)
    assert len(re.findall(r"Exchange ", plan(frame))) == 1
    plain = features.volume_features(features.return_features(features.base_features(i.prices()), (5, 20)), (20,))
    plain = plain.join(i.scored().select("symbol", "date", "score", "forward_return", F.col("next_open").alias("no")), ["symbol", "date"])
    names = ["symbol", "date", *q.FEATURES, "score", "forward_return", "no", "exit_close_20d"]
    assert rows(frame, *names) == rows(plain, *names) and frame.columns == [*plain.columns, "target"]


def test_summaries_store_no_more_than_they_read(spark, monkeypatch):
    from panelspark.functions import crosssection
    from panelspark.operators import models

    stored = []
    cut = models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    monkeypatch.setattr(crosssection, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    df = spark.range(400).select(F.lit(1).alias("split_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("date"), F.col("id").cast("string").alias("symbol"),
                                 F.rand(1).alias("prediction"), F.rand(2).alias("target"), F.rand(3).alias("forward_return"), F.lit(1.0).alias("adj_close"))
    out = models.summarize_splits(df, models.ModelConfig(target="target", outcome="forward_return"))
    assert stored[0] == ["split_id", "date", "symbol", "prediction", "target", "forward_return"]
    assert not any({"date", "symbol", "target"} <= set(c) for c in stored[1:])  # ranks read what is stored already
    line = out.first()
    want = df.toPandas()
    assert line["validation_rows"] == 400 and abs(line["ic_spearman"] - want["prediction"].rank().corr(want["target"].rank())) < 1e-9


# --- F15 ----------------------------------------------------------------------------------------------


def test_buckets_of_scores_order_only_what_they_read(spark, monkeypatch):
    from panelspark.operators import reports

    stored = []
    cut = cs.cut_lineage
    monkeypatch.setattr(cs, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    p = panel(spark).filter("symbol is not null").select("symbol", "date", F.col("g").alias("split_id"), F.round("x", 2).alias("score"), F.col("x").alias("target"), (F.col("x") - 0.5).alias("forward_return"), F.lit("w").alias("wide"))
    out = reports.score_buckets(p, buckets=4).toPandas().sort_values(["split_id", "score_bucket"])
    assert not any("wide" in c for c in stored)
    data = p.toPandas().sort_values(["split_id", "score", "date", "symbol"])
    place, n = data.groupby("split_id").cumcount(), data.groupby("split_id")["score"].transform("size")
    data["bucket"] = (-(-(place * 4.0 / (n - 1)) // 1)).clip(lower=1).astype(int)
    assert list(out["rows"]) == list(data.groupby(["split_id", "bucket"]).size())


# --- F1 -----------------------------------------------------------------------------------------------


def test_signatures_are_made_once(spark, monkeypatch):
    from panelspark.llm import jaccard

    seen = []
    monkeypatch.setattr(jaccard, "components", lambda edges: seen.append(plan(edges)) or edges.select(F.col("u").alias("node"), F.col("v").alias("root")))
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, 60 + k))) for k in range(20)], "doc_id long, text string")
    jaccard.regions(docs, jaccard.Rule())
    assert len(seen) == 1 and seen[0].count("MapInArrow") == 1


def test_settled_documents_are_not_shuffled(spark):
    from panelspark.llm import jaccard

    base = [" ".join(f"a{k}b{j}" for j in range(40)) for k in range(30)]
    rows_ = [(k, base[k // 2] if k % 3 else base[k // 2] + " more") for k in range(60)] + [(7, base[3]), (100, None), (101, ""), (100, None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    out = jaccard.deduplicate(docs)
    kept = sorted(out.collect(), key=str)
    assert [r["doc_id"] for r in kept if r["text"]] == sorted((2 * k for k in range(30)), key=str)
    assert sorted(r["doc_id"] for r in kept if not r["text"]) == [100, 100, 101]
    assert sorted(jaccard.deduplicate(docs, bits=1 << 15).collect(), key=str) == kept
    certain = out._jdf.queryExecution().optimizedPlan().toString().split("\n:- ")[1]
    assert "settled" in certain and "Aggregate" not in certain and "Join" not in certain


# --- F13 ----------------------------------------------------------------------------------------------


def test_points_of_a_lookup_are_shuffled_once(spark):
    i = Inputs(spark, SF)
    orders = i.ledger().select("order_id", "symbol", "planned_date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what is read again
    try:
        out = asof.asof_lookup(orders, i.prices().select("symbol", F.col("date").alias("day"), "open"), by="symbol", left_on="planned_date", right_on="day", values=["open"], direction="forward", strict=True)
        text = plan(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("ReusedExchange") >= 1 and text.count("FileScan") == 3, text


# --- F9 -----------------------------------------------------------------------------------------------


def test_sector_returns_come_to_the_positions(spark):
    i = Inputs(spark, "/root/testdata/sf0.01")
    book = q.reopened(i)
    days = q.ledger.position_days(q.ledger.normalize_ledger(book), i.prices(), q.RULES, universe=q.sectors(i))
    join = [line for line in plan(days).splitlines() if "Join" in line and "sector" in line]
    assert len(join) == 1 and "BroadcastHashJoin" in join[0]
    assert days.filter("sector_return is not null").count() > 0
