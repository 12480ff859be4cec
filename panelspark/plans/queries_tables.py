"""Registered queries: sources, dimensions, documents, stores, metrics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar
from panelspark.operators import lanes, ledger, monitoring, validate
from panelspark.plans.fixtures import symbol_of
from panelspark.plans.registry import query, rounded
from panelspark.session import run_dir
from panelspark.sources import documents, files, store
from panelspark.streaming import monitor

# --- sources --------------------------------------------------------------------------------------


@query("typed_prices")
def typed_prices(i):
    """Price rows as text, as a CSV reader delivers them, to the typed panel."""
    p = i.prices()
    text = p.select(*[F.col(c).cast("string").alias(c) for c in p.columns]).withColumn("symbol", F.lower("symbol"))
    return files.typed_prices(text)


def tickers(i):
    """Columns of a wide frame: one per nation, a table whose size does not change; its symbols are those of the first suppliers."""
    return [f"S{r.n_nationkey + 1:010d}" for r in i.table("nation").select("n_nationkey").orderBy("n_nationkey").collect()]


def widened(rows, index, names, fields):
    """One column per name and field."""
    cells = [F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{s}|{f}") for s in names for f, c in fields.items()]
    return rows.groupBy(index).agg(*cells)


@query("vendor_frame_melted")
def vendor_frame_melted(i):
    """Wide vendor frame (one column per ticker and field) back to the long panel."""
    names = tickers(i)
    fields = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
    wide = widened(i.prices().withColumnRenamed("date", "Date"), "Date", names, fields)
    return files.normalize_vendor_prices(wide, [*names, "MISSING"])


def raw_marks(i):
    """Events as vendor marks: text prices, some missing, some names in lower case."""
    e = i.table("events")
    bad = F.col("event_id") % 97 == 0
    return e.select(
        F.col("ts").alias("date"), F.lower(symbol_of("user_id")).alias("symbol"),
        F.when(bad, "n/a").otherwise((F.col("value") * 10.0).cast("string")).alias("close"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value") * 11.0).alias("high"))


@query("normalized_marks")
def normalized_marks(i):
    return rounded(files.normalize_marks(raw_marks(i), "events"))


@query("vendor_intraday_marks")
def vendor_intraday_marks(i):
    """Wide intraday frame by hour, all marks dealt to its tickers, to marks."""
    names = tickers(i)
    e = i.marks().withColumn("Datetime", F.date_trunc("hour", "timestamp")).withColumn("symbol", F.element_at(F.array(*map(F.lit, names)), (F.substring("symbol", 2, 10).cast("long") % len(names) + 1).cast("int")))
    wide = widened(e, "Datetime", names, dict.fromkeys(("Close", "Adj Close", "High"), "price"))
    return rounded(files.normalize_vendor_intraday(wide, names))


def raw_listing(i):
    """Parts as lines of a pipe-separated listing with a footer."""
    p = i.table("part")
    kind = F.element_at(F.array(*[F.lit(x) for x in (" Common Stock", " Warrants", " Preferred Series A", " Ordinary Shares")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = p.select(
        F.concat(F.lit(" "), F.lower("p_type"), F.lit("."), F.col("p_partkey"), F.lit(" ")).alias("Symbol"),
        F.concat("p_name", kind).alias("Security Name"), F.when(F.col("p_size") % 7 == 0, "Y").otherwise("N").alias("ETF"),
        F.when(F.col("p_size") % 11 == 0, "Y").otherwise("N").alias("Test Issue"),
        F.substring("p_brand", -1, 1).alias("code"))
    return rows


@query("nasdaq_listing")
def nasdaq_listing(i):
    return files.nasdaq_listed(raw_listing(i)).drop("notes")


@query("other_listing")
def other_listing(i):
    code = F.element_at(F.array(*[F.lit(x) for x in "ANPZVX"]), (F.col("code").cast("int") % 6 + 1))
    return files.other_listed(raw_listing(i).withColumnRenamed("Symbol", "ACT Symbol").withColumn("Exchange", code)).groupBy("exchange").agg(
        F.count("*").alias("listings"))


@query("us_listed_universe")
def us_listed_universe(i):
    raw = raw_listing(i)
    other = raw.withColumnRenamed("Symbol", "ACT Symbol").withColumn("Exchange", F.lit("N")).filter(F.col("code").isin("1", "2"))
    return files.us_listed(raw.filter(~F.col("code").isin("1", "2")), other).groupBy("category", "exchange").agg(F.count("*").alias("listings"))


@query("normalized_universe")
def normalized_universe(i):
    """Symbols in mixed spelling with repeats; the first arrival wins."""
    u = i.universe()
    other = u.withColumns({"symbol": F.concat(F.lit(" "), F.lower("symbol")), "name": F.lit("later"), "arrival": F.lit(2)})
    dotted = u.withColumns({"symbol": F.concat("symbol", F.lit(".a")), "arrival": F.lit(1)})
    return files.normalize_universe(u.withColumn("arrival", F.lit(1)).unionByName(other).unionByName(dotted), "arrival")


@query("broad_universe")
def broad_universe(i):
    return files.broad_universe(i.universe())


@query("appended_promotions")
def appended_promotions(i):
    u = i.universe()
    tracked = u.filter(~F.col("symbol").endswith("3")).withColumn("notes", F.lit(""))
    extra = u.filter(F.substring("symbol", -1, 1).isin("3", "4")).withColumns({"notes": F.lit("promoted"), "category": F.lit("discovery")})
    return files.append_promotions(tracked, extra).select("symbol", "category", "notes")


@query("watchlist_symbols")
def watchlist_symbols(i):
    """Comma-separated watchlists, one per customer, to distinct symbols."""
    c = i.table("customer")
    text = F.concat(F.lower(symbol_of("c_nationkey")), F.lit(", "), symbol_of("c_custkey"), F.lit(",,"))
    return validate.watchlist_symbols(c.select(text.alias("symbol")))


@query("html_constituents")
def html_constituents(i):
    """Constituent tables out of web pages: one page per supplier, after a table of another kind."""
    u = i.universe()
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    head = "<tr><th>Symbol</th><th>Security</th><th>Founded</th><th>GICS Sector</th><th>GICS Sub-Industry</th></tr>"
    html = F.concat(
        F.lit("<html><table><tr><td>x</td></tr></table><p>text</p><table>"), F.lit(head),
        row(F.concat(F.lower("symbol"), F.lit(".b")), F.concat(F.lit(" "), F.col("name")), F.lit("1990"), F.col("sector"), F.concat(F.lit("A &amp; "), F.col("industry"))),
        F.lit("<tr><td>short</td></tr></table></html>"))
    pages = u.select(F.col("symbol").alias("page_id"), html.alias("html"))
    return documents.constituents(documents.html_table_rows(pages)).drop("notes")


@query("page_table_rows")
def page_table_rows(i):
    """Rows of the tables of every page, each page followed by two tables whose sizes come from its id."""
    row = lambda n: F.repeat(F.lit("<tr><td>a</td><th>b</th></tr>"), n)
    n = F.col("page_id").cast("int")
    html = F.concat(F.coalesce("html", F.lit("")), F.lit("<TABLE class='x'>"), row(n % 4 + 1), F.lit("</table><p>text</p><table>"), row(n % 3), F.lit("</table>"))
    rows = documents.html_table_rows(i.table("pages").select("page_id", html.alias("html")))
    return rows.groupBy("page_id").agg(F.countDistinct("table_ix").alias("tables"), F.count("*").alias("rows"))


@query("input_file_metadata")
def input_file_metadata(i):
    """Every input file with its size and hash."""
    meta = store.file_metadata(i.spark, [f"{i.sf_dir}/*.parquet"])
    return meta.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "exists", "sha256", "hashed_in_blocks")


# --- dimensions and documents ---------------------------------------------------------------------


@query("latest_rows_for_symbols")
def latest_rows_for_symbols(i):
    wanted = i.universe().select("symbol")
    return documents.latest_rows(i.prices().select("symbol", "date", "close", "volume"), wanted)


@query("price_history_documents")
def price_history_documents(i):
    wanted = i.universe().select("symbol")
    out = documents.price_history(i.prices().select("symbol", "date", "close"), wanted, None)
    return out.select("symbol", F.size("prices").alias("bars"), F.col("prices")[0]["date"].alias("first_date"),
                      F.aggregate("prices", F.lit(0.0), lambda a, x: F.greatest(a, x["close"])).alias("highest"))


@query("merged_price_sources")
def merged_price_sources(i):
    """Two overlapping price sources; the primary wins on equal dates."""
    p = i.prices().select("symbol", "date", "close")
    primary = p.filter(F.dayofmonth("date") <= 20)
    fallback = p.filter(F.dayofmonth("date") >= 15).withColumn("close", F.lit(-1.0))
    out = documents.merge_prices(primary, fallback)
    return out.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("date").alias("first_date"), F.count_if(F.col("close") < 0).alias("from_fallback"))


@query("merged_records")
def merged_records(i):
    u = i.universe().select("symbol", "name", "sector")
    primary = u.filter(F.col("symbol").endswith("1"))
    return documents.merge_records(primary, u.filter(F.substring("symbol", -1, 1).isin("1", "2")).withColumn("name", F.lit("fallback")))


@query("stock_documents")
def stock_documents(i):
    u = i.universe()
    wanted = u.select("symbol")
    tracked, broad = u.filter("sector = 'ASIA'").select("symbol", "name", "sector"), u.select("symbol", "sector")
    position = i.ledger().filter("status = 'planned'").select("symbol", "status", "shares")
    out = documents.stock_documents(wanted, [tracked, broad], i.prices().select("symbol", "date", "close"), None, paperPosition=position)
    doc = F.col("document")
    return out.select("symbol", F.get_json_object(doc, "$.profile.name").alias("name"), F.get_json_object(doc, "$.profile.sector").alias("sector"),
                      F.get_json_object(doc, "$.paperPosition.status").alias("position"), F.get_json_object(doc, "$.prices[0].date").alias("first_date"))


@query("collected_symbols")
def collected_symbols(i):
    return monitoring.session_symbols(i.universe().filter("sector = 'ASIA'"), i.ledger().filter("status = 'planned'"), i.marks().select(F.lower("symbol").alias("symbol")))


@query("ordered_lane_lists")
def ordered_lane_lists(i):
    lane = F.element_at(F.array(*[F.lit(x) for x in ("value_recoveries", "zeta", "momentum_breakouts", "alpha", "")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    rows = i.table("lineitem").select("l_suppkey", lane.alias("lane"))
    return rows.groupBy(symbol_of("l_suppkey").alias("symbol")).agg(F.array_join(lanes.ordered_lanes(F.collect_set("lane")), ", ").alias("lanes"))


@query("stable_order_ids")
def stable_order_ids(i):
    o = i.table("orders").select(F.to_date("o_orderdate").alias("planned_date"), symbol_of("o_custkey").alias("symbol"), "o_orderkey")
    return ledger.order_ids(o, order=("symbol", "o_orderkey")).select("o_orderkey", "order_id")


@query("scalar_functions")
def scalar_functions(i):
    """Text, number and date expressions over the order table."""
    o = i.table("orders")
    day = F.to_date("o_orderdate")
    price = F.col("o_totalprice")
    return o.select(
        "o_orderkey", scalar.listing_symbol(F.concat(F.lit(" brk&amp;"), F.lower("o_orderpriority"), F.lit("/a "))).alias("ticker"),
        scalar.fixed(price, 2).alias("two_digits"), scalar.zero_padded(F.col("o_orderkey") % 7).alias("padded"),
        scalar.label({"O": "open", "F": "filled"}, "o_orderstatus").alias("state"),
        F.round(scalar.ratio(price, F.col("o_custkey") % 5), 4).alias("safe_ratio"),
        scalar.number(F.when(F.col("o_orderkey") % 3 == 0, "NaN").otherwise(F.col("o_custkey").cast("string"))).alias("coerced"),
        F.round(scalar.row_median([F.col("o_custkey").cast("double"), F.col("o_orderkey").cast("double"), F.when(F.col("o_orderkey") % 2 == 0, price)]), 4).alias("middle"),
        scalar.texts(F.when(price > 200000, "large"), F.when(F.col("o_orderstatus") == "O", "open"), F.when(F.month(day) == 12, "december")).alias("tags"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"))


@query("tagged_session_modes")
def tagged_session_modes(i):
    return i.marks().groupBy(scalar.session_mode("timestamp").alias("mode")).agg(F.count("*").alias("marks"))


@query("event_metric_maps")
def event_metric_maps(i):
    """Scalar JSON fields as prefixed metric maps of two documents, merged."""
    e = i.table("events").select("event_id", "props", F.to_json(F.struct(F.col("event_type").alias("kind"), F.array("value").alias("nested"))).alias("doc"))
    m = store.merged_metrics({"props": "props", "doc": "doc"})
    return e.select("event_id", m["props_k"].alias("props_k"), m["doc_kind"].alias("doc_kind"), F.size(F.map_keys(m)).alias("fields"))


@query("history_rows")
def history_rows(i):
    """Run history rows out of metric maps, with the fallback for the price date."""
    e = i.table("events")
    doc = F.to_json(F.struct(
        F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("monitor_latest_price_date"),
        F.lit("2024-01-31").alias("portfolio_as_of_date"), F.col("value").alias("account_equity"),
        F.when(F.col("event_id") % 3 == 0, "NaN").otherwise("1.5").alias("backtest_sharpe")))
    rows = e.select(F.col("event_id").cast("string").alias("run_id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("local_time"), F.lit("after-close").alias("mode"),
                    F.from_json(doc, "map<string,string>").alias("metrics"))
    return store.history_row(rows).select("run_id", "local_time", "mode", "latest_price_date", "account_equity", "backtest_sharpe", "audit_status")


@query("tolerant_json")
def tolerant_json(i):
    """Documents with bare NaN tokens."""
    e = i.table("events")
    text = F.concat(F.lit('{"v": '), F.when(F.col("event_id") % 4 == 0, "NaN").otherwise(F.col("value").cast("string")), F.lit(', "w": [1, -Infinity]}'))
    parsed = scalar.finite_json(text, "v double, w array<double>")
    return e.select("event_id", parsed["v"].alias("v"), F.size(parsed["w"]).alias("n"), scalar.cell(F.col("value").cast("string"))["number"].alias("cell"))


# --- stores ---------------------------------------------------------------------------------------


@query("upserted_orders")
def upserted_orders(i):
    """Order versions reduced to the newest one per id."""
    o = i.table("orders")
    versions = o.select((F.col("o_orderkey") / 4).cast("long").alias("order_id"), F.col("o_orderkey").alias("updated_at"), "o_orderstatus", "o_totalprice")
    return store.keep_latest(versions, ["order_id"], F.col("updated_at"))


@query("archived_orders")
def archived_orders(i):
    kept, skipped = ledger.compact(i.ledger())
    old = skipped.filter("planned_date < date '1999-01-01'").withColumn("skip_reason", F.lit("old"))
    return store.append_archive(old, skipped.filter("planned_date >= date '1998-01-01'")).groupBy("skip_reason").agg(F.count("*").alias("orders"))


@query("deduplicated_marks")
def deduplicated_marks(i):
    """Marks per minute and symbol; a repeated key keeps the newer arrival."""
    m = i.marks().withColumn("timestamp", F.date_trunc("day", "timestamp"))
    old = m.groupBy("timestamp", "symbol").agg(F.min("price").alias("price"))
    new = m.filter(F.col("price") > 2500).groupBy("timestamp", "symbol").agg(F.max("price").alias("price"))
    return store.append_marks(old, new)


@query("model_registry_best")
def model_registry_best(i):
    """Registry rows with JSON metrics; the best one by a metric inside the JSON."""
    s = i.table("supplier")
    models_ = s.select(F.concat(F.lit("m"), F.col("s_suppkey")).alias("model_id"), F.when(F.col("s_suppkey") % 2 == 0, "ridge").otherwise("forest").alias("model_type"),
                       F.to_json(F.struct(F.col("s_acctbal").alias("sharpe"), (F.col("s_nationkey") / 10.0).alias("ic"))).alias("metrics_json"))
    best = store.best_by_metric(models_.filter("model_type = 'ridge'"), "sharpe")
    return best.select("model_id", "model_type", "metric_value")


@query("model_comparison")
def model_comparison(i):
    s = i.table("supplier")
    models_ = s.select(F.concat(F.lit("m"), F.col("s_suppkey")).alias("model_id"), F.lit("ridge").alias("model_type"),
                       F.to_json(F.struct(F.col("s_acctbal").alias("sharpe"), F.col("s_nationkey").cast("double").alias("ic"))).alias("metrics_json"))
    return store.compare_models(models_, ["sharpe", "ic"])


# --- streams --------------------------------------------------------------------------------------


@query("intraday_latest_marks")
def intraday_latest_marks(i):
    return monitor.latest_marks(i.marks())


def intraday_book(i):
    """Open positions on the symbols that have marks, bought at a fixed price each."""
    n = F.substring("symbol", -3, 3).cast("int")
    u = i.universe().select("symbol", n.alias("n"))
    return u.select(
        F.concat(F.lit("O"), F.col("symbol")).alias("order_id"), F.lit("open").alias("status"), "symbol", F.lit(10.0).alias("shares"),
        F.lit("2024-01-01").cast("date").alias("fill_date"), (200.0 + F.col("n") * 5).alias("entry_price"),
        (2000.0 + F.col("n") * 50).alias("entry_value"), F.lit(2.0).alias("entry_cost"), (100.0 + F.col("n") * 12).alias("highest_close_since_entry"))


INTRADAY = ledger.LedgerConfig(exit_rules=ledger.ExitRules(stop_loss_pct=-0.5, trail_activate_at=0.12, trail_from_high_pct=-0.3))


@query("intraday_exit_decisions")
def intraday_exit_decisions(i):
    decisions, _ = monitor.evaluate_exits(intraday_book(i), i.marks(), INTRADAY)
    return rounded(decisions.select("symbol", "action", "triggered", "price", "current_return", "highest_price_since_entry", "trailing_stop_activated", "exit_reason", "exit_signal_value"))


@query("intraday_updated_ledger")
def intraday_updated_ledger(i):
    _, updated = monitor.evaluate_exits(intraday_book(i), i.marks(), INTRADAY)
    return rounded(updated.select("order_id", "status", "exit_price", "exit_value", "net_pnl", "exit_reason"), 4)


@query("intraday_decision_summary")
def intraday_decision_summary(i):
    decisions, _ = monitor.evaluate_exits(intraday_book(i), i.marks(), INTRADAY)
    return monitor.decision_summary(decisions).drop("latest_timestamp")


@query("positions_daily_highs")
def positions_daily_highs(i):
    return monitor.daily_highs(i.ledger(), i.prices())


@query("hourly_bars")
def hourly_bars(i):
    return rounded(monitor.bars(files.normalize_marks(i.marks())).drop("end"))


@query("activity_sessions")
def activity_sessions(i):
    return monitor.sessions(i.marks().withColumn("timestamp", F.col("timestamp").cast("timestamp")), "2 hours").withColumns(
        {"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


def mark_stream(i, lateness="1 hour"):
    """The event table as a stream of marks."""
    schema = i.table("events").schema
    raw = i.spark.readStream.schema(schema).parquet(f"{i.sf_dir}/events*.parquet")
    marks = raw.select(F.col("ts").alias("timestamp"), symbol_of("user_id").alias("symbol"), (F.col("value") * 10.0).alias("price"))
    return files.normalize_marks(marks).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)


def drained(i, stream, name, mode):
    """Run a stream over what is there into a Parquet folder and read it back."""
    out = run_dir(i.spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{out}/rows").start().awaitTermination()
        return i.spark.read.parquet(f"{out}/rows")

    def save(batch, number):
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/n={number}")

    writer.outputMode("update").foreachBatch(save).start().awaitTermination()
    return i.spark.read.parquet(f"{out}/rows").drop("n")


@query("streaming_hourly_bars")
def streaming_hourly_bars(i):
    """Hourly bars in append mode: only windows the watermark has passed are final."""
    out = drained(i, monitor.bars(mark_stream(i)), "bars", "append")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")).drop("end"))


@query("streaming_latest_marks")
def streaming_latest_marks(i):
    out = drained(i, monitor.latest_marks(mark_stream(i).select("symbol", "timestamp", "price")), "latest", "update")
    last = store.keep_latest(out, ["symbol"], F.col("__batch")).drop("__batch")
    return last.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("streaming_deduplicated_marks")
def streaming_deduplicated_marks(i):
    """Marks by the hour: the newest of an hour stays, its arrival being its price here."""
    hourly = mark_stream(i).select("symbol", F.date_trunc("hour", "timestamp").alias("timestamp"), "price", F.col("price").alias("arrival"))
    out = drained(i, monitor.deduplicated(hourly, "arrival"), "dedup", "update")
    last = store.keep_latest(out, ["symbol", "timestamp"], F.col("__batch"))
    return rounded(last.select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "price"))


@query("streaming_expired_marks")
def streaming_expired_marks(i):
    """Latest mark of every symbol on a stream whose state ends after twelve hours without marks."""
    from panelspark.plans.fixtures import Inputs

    session = i.spark.newSession()  # the state store is set for this stream alone
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", i.spark.conf.get("spark.sql.shuffle.partitions"))
    marks = mark_stream(Inputs(session, i.sf_dir)).select("symbol", "timestamp", "price", F.col("price").alias("high"))
    out = drained(i, monitor.expiring_marks(marks, 12 * 3600 * 1000), "expiring", "append")
    last = out.groupBy("symbol").agg(F.max(F.struct("timestamp", "price", "expired")).alias("x")).select("symbol", "x.*")
    return last.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("streaming_monitor_cycle")
def streaming_monitor_cycle(i):
    """A monitoring run over the mark stream against a stored ledger; returns the stored result."""
    tables = store.TableStore(i.spark, run_dir(i.spark, "monitor"))
    tables.replace("ledger", ledger.normalize_ledger(intraday_book(i)))
    monitor.start_monitor(mark_stream(i), tables, INTRADAY, f"{tables.root}/checkpoint", available_now=True).awaitTermination()
    out = monitor.monitored_ledger(tables, INTRADAY)
    return rounded(out.select("order_id", "status", "exit_price", "exit_value", "net_pnl", "exit_reason"), 4)
