"""Registered queries that write stored tables and read them back, and the workflow."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelspark.operators import lanes, models, workflow
from panelspark.plans.queries_evaluation import DISCOVERY, MODEL, PORTFOLIO, discovery_frame, funnel, lane_frame, two_features, watched
from panelspark.plans.registry import query, rounded
from panelspark.session import run_dir
from panelspark.sources import store


def orders_of(i, condition, status):
    o = i.table("orders").filter(condition)
    return o.select(F.col("o_orderkey").cast("string").alias("order_id"), F.lit(status).alias("status"), F.concat(F.lit("C"), F.col("o_custkey")).alias("symbol"))


def written_ledger(i):
    """Planned orders, then newer versions of some and new ones, then more new ones beside known ones."""
    tables = store.TableStore(i.spark, run_dir(i.spark, "ledger"))
    tables.replace_ledger(orders_of(i, "o_orderkey % 3 = 0", "planned"))
    tables.upsert_orders(orders_of(i, "o_orderkey % 6 = 0", "open").unionByName(orders_of(i, "o_orderkey % 3 = 1", "planned")))
    tables.append_orders(orders_of(i, "o_orderkey % 3 = 2 or o_orderkey % 6 = 0", "closed"))
    return tables


@query("stored_ledger")
def stored_ledger(i):
    return written_ledger(i).ledger().select("order_id", "status", "symbol")


@query("stored_open_positions")
def stored_open_positions(i):
    return written_ledger(i).open_positions().select("order_id", "symbol")


@query("exported_ledger")
def exported_ledger(i):
    """The stored ledger through a CSV export."""
    tables = written_ledger(i)
    path = run_dir(i.spark, "export")
    tables.export_csv("ledger", path)
    out = i.spark.read.option("header", True).csv(path)
    return out.groupBy("status").agg(F.count("*").alias("orders"), F.min("order_id").alias("first_id"), F.max("symbol").alias("last_symbol"))


@query("stored_run_history")
def stored_run_history(i):
    """Run rows of two schemas, appended one after the other."""
    tables = store.TableStore(i.spark, run_dir(i.spark, "history"))
    c = i.table("customer")
    row = lambda part: c.filter(F.col("c_custkey") % 2 == part)
    key = [F.col("c_custkey").cast("string").alias("run_id"), F.format_string("2024-01-%02d", F.col("c_nationkey") + 1).alias("local_time")]
    tables.append_run(row(0).select(*key, F.when(F.col("c_nationkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("account_equity")))
    tables.append_run(row(1).select(*key, F.col("c_mktsegment").alias("mode")))
    return tables.history().select("run_id", "local_time", "account_equity", "mode")


@query("stored_snapshots")
def stored_snapshots(i):
    """Account snapshots by day; a day written again replaces the earlier row."""
    tables = store.TableStore(i.spark, run_dir(i.spark, "snapshots"))
    o = i.table("orders").select(F.concat(F.lit("A"), F.col("o_custkey")).alias("account_id"), F.to_date("o_orderdate").alias("snapshot_date"), "o_totalprice")
    first = o.groupBy("account_id", "snapshot_date").agg(F.max("o_totalprice").alias("equity"))
    tables.add_snapshot(first)
    tables.add_snapshot(first.filter(F.dayofmonth("snapshot_date") <= 10).withColumn("equity", F.lit(-1.0)))
    return tables.snapshots().select("account_id", "snapshot_date", "equity")


@query("stored_models")
def stored_models(i):
    """A registry of as many models as suppliers: the best of a type among all of them."""
    tables = store.TableStore(i.spark, run_dir(i.spark, "models"))
    s = i.table("supplier")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "ridge").otherwise("forest")
    tables.replace("models", s.select(
        F.concat(F.lit("m"), F.col("s_suppkey")).alias("model_id"), kind.alias("model_type"), F.to_json(F.struct(F.col("s_acctbal").alias("sharpe"))).alias("metrics_json"),
        F.timestamp_seconds(F.col("s_suppkey") * 60).alias("created_at")))
    best = tables.best_model("sharpe", "ridge").select("model_id", "model_type", F.col("metric_value").alias("sharpe"))
    listed = tables.list_models("ridge").agg(F.count("*").alias("models"), F.max_by("model_id", "created_at").alias("newest"))
    return best.join(F.broadcast(listed))


@query("stored_lanes")
def stored_lanes(i):
    """Watchlists of the funnel written by lane and read back."""
    found = funnel(i)
    path = run_dir(i.spark, "lanes")
    store.write_lanes(found, path)
    out = i.spark.read.schema(found["watchlists"].schema).parquet(f"{path}/lanes")  # no lane may be populated
    return rounded(out.select("symbol", "lane", "rank", "lane_score", "discovery_score"))


@query("stored_tables")
def stored_tables(i):
    """Two tables written as CSV and counted by type of row."""
    path = run_dir(i.spark, "tables")
    store.write_tables({"orders": i.table("orders").select("o_orderstatus", "o_orderkey"), "parts": i.table("part").select("p_brand", "p_partkey")}, path, "csv")
    read = lambda name: i.spark.read.option("header", True).csv(f"{path}/{name}")
    a = read("orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("rows"))
    return a.unionByName(read("parts").groupBy(F.col("p_brand").alias("kind")).agg(F.count("*").alias("rows")))


@query("workflow_summary")
def workflow_summary(i):
    """All stages in one call, the lane trades passed on to the portfolio."""
    snapshot = discovery_frame(i, ["1999-06-15"])
    frame = lane_frame(i, lanes.rebalance_dates(i.days(), "monthly"))
    made = workflow.run_workflow(frame, i.prices(), as_of_date="1999-06-15", snapshot=snapshot, watchlist=watched(i),
                                 discovery_config=DISCOVERY, portfolio_config=PORTFOLIO, top_n=5)
    return made.summary()


@query("registered_walk_forward")
def registered_walk_forward(i):
    """A walk-forward saved in one call, read back, scored with, compared and deleted."""
    tables = store.TableStore(i.spark, run_dir(i.spark, "registry"))
    rows, cfg = two_features(i), replace(MODEL, alpha=500.0)
    run = models.walk_forward(rows, ("x1", "x2"), cfg)
    summary = models.summarize_splits(run["predictions"], cfg)
    kept = tables.save_walk_forward(run, summary, features=("x1", "x2"), config=cfg)
    gone = tables.save_walk_forward(run, summary, features=("x1", "x2"), config=cfg)
    run["release"]()
    tables.delete_model(gone)
    scored = tables.load_model(kept).transform(rows.filter("x1 is not null and x2 is not null")).select("date", "symbol", "prediction")
    line = tables.list_models("ridge").select("model_type", "version", "training_rows", "training_symbols", F.get_json_object("metrics_json", "$.split_count").cast("long").alias("split_count"))
    return rounded(scored.join(F.broadcast(line)))


@query("replaced_history")
def replaced_history(i):
    """Run history replaced as a whole and read back through its CSV export."""
    tables = store.TableStore(i.spark, run_dir(i.spark, "history"))
    c = i.table("customer").select(F.col("c_custkey").cast("string").alias("run_id"), F.col("c_mktsegment").alias("mode"), F.col("c_acctbal").alias("account_equity"))
    tables.append_run(c.filter("account_equity < 0"))
    tables.replace_history(c)
    path = run_dir(i.spark, "export")
    tables.export_csv("history", path)
    out = i.spark.read.option("header", True).csv(path)
    return out.select("run_id", "mode", F.col("account_equity").cast("double").alias("account_equity"))


@query("rebuilt_history")
def rebuilt_history(i):
    """History rows from one summary document per month of orders."""
    path = run_dir(i.spark, "documents")
    o = i.table("orders").groupBy(F.trunc("o_orderdate", "month").alias("d")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    metrics = F.create_map(F.lit("account_equity"), F.col("top").cast("string"), F.lit("audit_error_count"), F.col("n").cast("string"), F.lit("portfolio_as_of_date"), F.col("d").cast("string"))
    doc = F.to_json(F.struct(F.col("d").cast("string").alias("run_id"), F.concat(F.col("d").cast("string"), F.lit("T18:00:00")).alias("local_time"), F.lit("after_close").alias("mode"), metrics.alias("metrics")))
    o.select(doc.alias("value"), F.col("d").cast("string").alias("month")).write.partitionBy("month").text(path)
    return store.rebuild_history(i.spark, f"{path}/month=*/*.txt").select("run_id", "local_time", "mode", "latest_price_date", "account_equity", "audit_error_count")


@query("run_manifest_inputs")
def run_manifest_inputs(i):
    """The lineage record of a run, taken apart again."""
    inputs = store.file_metadata(i.spark, [f"{i.sf_dir}/*.parquet"]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "sha256")
    text = store.run_manifest(i.spark, "research", parameters={"horizon": 5}, inputs=inputs, outputs={"frame": "frame"}, as_of_date="1999-06-15")
    made = text.select(F.from_json("value", "run_type string, as_of_date string, parameters map<string,string>, outputs map<string,string>, inputs array<struct<file:string,size_bytes:long,sha256:string>>").alias("m"))
    return made.select("m.run_type", "m.as_of_date", F.col("m.parameters.horizon").alias("horizon"), F.col("m.outputs.frame").alias("frame"), F.explode("m.inputs").alias("x")).select("run_type", "as_of_date", "horizon", "frame", "x.*")
