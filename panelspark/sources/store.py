"""Versioned Parquet tables for ledgers, run history, account snapshots and the model registry.

A change writes its data into a folder of its own and becomes visible by an entry in the table's log, made with the file system's
exclusive create. Readers never see half a table, a writer that dies leaves the previous version in place and blocks nobody, and
of two writers that change the same version one starts again from what the other made.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.scalar import short_id
from panelspark.operators.ledger import LEDGER_COLUMNS, normalize_ledger
from panelspark.operators.linear import LinearFit

# Columns of the run history table.
HISTORY_COLUMNS = (
    "run_id", "local_time", "mode", "latest_price_date", "account_equity", "account_cash", "account_realized_pnl",
    "account_unrealized_pnl", "account_open_positions", "account_planned_orders", "monitor_waiting_for_fill",
    "monitor_exit_pending_positions", "monitor_hold_positions", "audit_status", "audit_error_count", "audit_warning_count",
    "portfolio_planned_order_count", "portfolio_planned_estimated_entry_value", "backtest_ending_equity", "backtest_total_return",
    "backtest_sharpe", "backtest_max_drawdown", "backtest_closed_win_rate",
)
HISTORY_TEXTS = ("run_id", "local_time", "mode", "latest_price_date", "audit_status")


def keep_latest(df: DataFrame, keys, order) -> DataFrame:
    """Newest row per key, reduced map-side so that a key with many versions stays cheap."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


#: How long a claimed version without content is waited for; writing the entry takes milliseconds.
CLAIM_SECONDS = 3.0


class TableStore:
    """Named tables under one root folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _log(self, name: str) -> dict[int, dict]:
        """Committed versions with their entries; an entry without content is that of a writer that died or is about to finish."""
        fs, target = self._fs(f"{self.root}/{name}/log")
        found = {}
        for status in fs.listStatus(target) if fs.exists(target) else ():
            label = status.getPath().getName()
            if label.isdigit():
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(status.getPath()), "UTF-8")
                try:
                    found[int(label)] = json.loads(text)
                except json.JSONDecodeError:
                    continue
        return found

    def _claimed(self, name: str) -> int:
        """The highest version that any writer has claimed."""
        fs, target = self._fs(f"{self.root}/{name}/log")
        labels = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return max((int(x) for x in labels if x.isdigit()), default=0)

    def _publish(self, name: str, version: int, entry: dict) -> bool:
        """Make ``version`` visible; false if another writer has claimed it."""
        fs, target = self._fs(f"{self.root}/{name}/log/{version:09d}")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def versions(self, name: str) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(self._log(name))

    def read(self, name: str) -> DataFrame | None:
        log = self._log(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{log[max(log)]['folder']}") if log else None

    def note(self, name: str) -> dict:
        """What the writer of the current version noted beside it."""
        log = self._log(name)
        return log[max(log)]["note"] if log else {}

    def change(self, name: str, build: Callable[[DataFrame | None], DataFrame], note: dict | None = None, attempts: int = 20) -> int:
        """Commit ``build(current table)`` as the next version and return its number.

        If another writer commits in between, the change is built again on what that writer made. ``note`` is kept with the version.
        """
        for _ in range(attempts):
            claimed = self._claimed(name)  # before the log: whoever commits after this has the number this change will ask for
            log = self._log(name)
            until = time.monotonic() + CLAIM_SECONDS
            while claimed > max(log, default=0) and time.monotonic() < until:
                time.sleep(0.1)  # an entry is about to be written, or its writer has died
                log = self._log(name)
            base = max(log, default=0)
            old = self.spark.read.parquet(f"{self.root}/{name}/{log[base]['folder']}") if log else None
            folder = f"data-{uuid.uuid4().hex}"
            build(old).write.mode("error").parquet(f"{self.root}/{name}/{folder}")
            if self._publish(name, claimed + 1, {"folder": folder, "note": note or {}}):
                return claimed + 1
        raise RuntimeError(f"{name!r} was changed by others {attempts} times in a row")

    def replace(self, name: str, df: DataFrame, note: dict | None = None) -> int:
        """Write ``df`` as the next version, whatever the table holds, and return its number."""
        return self.change(name, lambda old: df, note)

    def export_csv(self, name: str, path: str) -> None:
        """CSV export as a folder of part files, written in parallel."""
        table = self.read(name)
        if table is None:
            raise KeyError(f"no table named {name!r}")
        table.write.mode("overwrite").option("header", True).csv(path)

    # --- ledger ---

    def ledger(self) -> DataFrame | None:
        """All orders by plan date and id."""
        table = self.read("ledger")
        return table if table is None else table.orderBy("planned_date", "order_id")

    def open_positions(self) -> DataFrame | None:
        table = self.read("ledger")
        return table if table is None else table.filter("status = 'open'").orderBy("fill_date")

    def order(self, order_id: str) -> DataFrame | None:
        table = self.read("ledger")
        return table if table is None else table.filter(F.col("order_id") == order_id).limit(1)

    def replace_ledger(self, df: DataFrame) -> int:
        return self.replace("ledger", normalize_ledger(df).withColumn("updated_at", F.current_timestamp()))

    def upsert_orders(self, orders: DataFrame, arrival: str | None = None) -> int:
        """Insert or update by order id.

        Of several rows with one id the one with the greatest ``arrival`` wins, and without that column, or among equal ones, the
        greatest row by its columns in their order.
        """
        new = _newest(orders, arrival)

        def build(old):
            fresh = new.withColumns({"updated_at": F.current_timestamp(), "__new": F.lit(1)})
            if old is None:
                return fresh.drop("__new")
            both = old.withColumn("__new", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
            return keep_latest(both, ["order_id"], F.col("__new")).drop("__new")

        return self.change("ledger", build)

    def append_orders(self, orders: DataFrame, arrival: str | None = None) -> int:
        """Append orders with unknown ids and return how many there were; see :meth:`upsert_orders` for repeated ids."""
        new = _newest(orders, arrival)
        made = {}

        def build(old):
            fresh = new.withColumn("updated_at", F.current_timestamp())
            made["before"] = 0 if old is None else old.count()  # answered by Parquet footers
            return fresh if old is None else old.unionByName(fresh.join(old.select("order_id"), "order_id", "left_anti"), allowMissingColumns=True)

        version = self.change("ledger", build)
        return self.spark.read.parquet(f"{self.root}/ledger/{self._log('ledger')[version]['folder']}").count() - made["before"]

    # --- run history and snapshots ---

    def append_run(self, row: DataFrame) -> int:
        """Append run rows; an older stored schema is widened to the union of both."""
        new = history_row_types(row)
        return self.change("history", lambda old: new if old is None else old.unionByName(new, allowMissingColumns=True))

    def history(self) -> DataFrame | None:
        table = self.read("history")
        return table if table is None else table.orderBy(F.desc("local_time"))

    def replace_history(self, df: DataFrame) -> int:
        return self.replace("history", history_row_types(df))

    def add_snapshot(self, snapshot: DataFrame) -> int:
        """Append account snapshots; a repeated date replaces the earlier row."""
        keys = [c for c in ("account_id", "snapshot_date") if c in snapshot.columns]

        def build(old):
            if old is None:
                return snapshot
            both = old.withColumn("__new", F.lit(0)).unionByName(snapshot.withColumn("__new", F.lit(1)), allowMissingColumns=True)
            return keep_latest(both, keys, F.col("__new")).drop("__new")

        return self.change("snapshots", build)

    def snapshots(self) -> DataFrame | None:
        table = self.read("snapshots")
        return table if table is None else table.orderBy("snapshot_date")

    # --- model registry ---

    def list_models(self, model_type: str | None = None) -> DataFrame | None:
        """All models, newest first, optionally of one type."""
        table = self.read("models")
        if table is None:
            return None
        if model_type is not None:
            table = table.filter(F.col("model_type") == model_type)
        return table.orderBy(F.desc("created_at"), "model_id")

    def save_model(self, model, *, model_type: str, features, config: dict, metrics: dict, training_rows: int | None = None,
                   training_symbols: int | None = None, training_end_date: str | None = None) -> str:
        """Persist a fitted pipeline or linear model and register it; returns the new model id."""
        model_id = self.spark.range(1).select(short_id()).first()[0]
        path = f"{self.root}/artifacts/{model_id}"
        if isinstance(model, LinearFit):
            path += "/linear"
            model.save(self.spark, path)
        else:
            model.write().overwrite().save(path)
        line = (model_id, model_type, json.dumps(list(features)), json.dumps(config), json.dumps(metrics), path, training_rows,
                training_symbols, training_end_date)
        schema = ("model_id string, model_type string, feature_columns string, config_json string, metrics_json string, "
                  "artifact_path string, training_rows long, training_symbols long, training_end_date string")
        row = self.spark.createDataFrame([line], schema).withColumn("created_at", F.current_timestamp())

        def build(old):
            number = 1 if old is None else old.filter(F.col("model_type") == model_type).count() + 1
            numbered = row.withColumn("version", F.lit(number))
            return numbered if old is None else old.unionByName(numbered)

        self.change("models", build)
        return model_id

    def load_model(self, model_id: str):
        """Fitted pipeline, or nothing for an unknown id."""
        from pyspark.ml import PipelineModel

        table = self.read("models")
        found = None if table is None else table.filter(F.col("model_id") == model_id).first()
        if found is None:
            return None
        path = found["artifact_path"]
        return LinearFit.load(self.spark, path) if path.endswith("/linear") else PipelineModel.load(path)

    def save_walk_forward(self, run: dict, summary: DataFrame, *, features, config) -> str:
        """Save a walk-forward's last model with the figures of all its folds; ``run`` and ``summary`` as its operators return them."""
        figures = summary.agg(F.avg("risk_backtest_sharpe").alias("sharpe"), F.max("risk_backtest_sharpe").alias("best"), F.avg("ic_spearman").alias("ic"),
                              F.count("*").alias("splits"), F.sum("validation_rows").alias("predictions"), F.max("validation_end").alias("last")).first()
        size = run["rows"].agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols")).first()
        number = lambda x: 0.0 if x is None or x != x else float(x)
        metrics = {"sharpe": number(figures["sharpe"]), "best_split_sharpe": number(figures["best"]), "ic": number(figures["ic"]),
                   "split_count": int(figures["splits"]), "prediction_count": int(figures["predictions"] or 0)}
        return self.save_model(
            run["models"][-1], model_type=config.model_type, features=features, config=asdict(config), metrics=metrics, training_rows=size["rows"],
            training_symbols=size["symbols"], training_end_date=None if figures["last"] is None else str(figures["last"]))

    def best_model(self, metric: str, model_type: str | None = None) -> DataFrame | None:
        """Registry row with the highest metric among all models."""
        table = self.list_models(model_type)
        return None if table is None else best_by_metric(table, metric)

    def delete_model(self, model_id: str) -> bool:
        """Remove a registry row and its artifact; tells whether there was one."""
        table = self.read("models")
        if table is None or table.filter(F.col("model_id") == model_id).isEmpty():
            return False
        self.change("models", lambda old: old.filter(F.col("model_id") != model_id))
        fs, target = self._fs(f"{self.root}/artifacts/{model_id}")
        fs.delete(target, True)
        return True


def _newest(orders: DataFrame, arrival: str | None) -> DataFrame:
    """Normalised orders with one row per id."""
    new = normalize_ledger(orders)
    rest = [F.col(f"`{c}`") for c in new.columns if c != "order_id"]
    order = F.struct(*([F.col(arrival)] if arrival else []), *rest)
    return keep_latest(new, ["order_id"], order)


def history_row_types(df: DataFrame) -> DataFrame:
    """Run history columns with their types; NaN becomes null and missing columns are added."""
    cols = []
    for c in HISTORY_COLUMNS:
        if c not in df.columns:
            cols.append(F.lit(None).cast("string" if c in HISTORY_TEXTS else "double").alias(c))
        elif c in HISTORY_TEXTS:
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(None).cast("double")).alias(c))
    extras = [c for c in df.columns if c not in HISTORY_COLUMNS]
    return df.select(*cols, *extras)


def best_by_metric(models: DataFrame, metric: str) -> DataFrame:
    value = F.get_json_object("metrics_json", f"$.{metric}").try_cast("double")
    rows = models.withColumn("metric_value", value).filter("metric_value is not null and not isnan(metric_value)")
    return rows.orderBy(F.desc("metric_value"), "model_id").limit(1)


def compare_models(models: DataFrame, metrics=None) -> DataFrame:
    """One row per model with its metrics as columns."""
    table = models.select("model_id", "model_type", F.explode(F.from_json("metrics_json", "map<string,double>")).alias("metric", "value"))
    pivoted = table.groupBy("model_id", "model_type")
    pivoted = pivoted.pivot("metric", list(metrics)) if metrics else pivoted.pivot("metric")
    return pivoted.agg(F.first("value"))


def registry_metrics(summary: DataFrame) -> DataFrame:
    """Metrics row of a walk-forward summary for the registry."""
    return summary.agg(
        F.avg("risk_backtest_sharpe").alias("mean_sharpe"), F.max("risk_backtest_sharpe").alias("max_sharpe"),
        F.avg("ic_spearman").alias("mean_ic"), F.count("*").alias("split_count"), F.sum("validation_rows").alias("prediction_count"))


# --- metric maps and history rows -----------------------------------------------------------------


def metric_map(json_text, prefix: str):
    """Scalar fields of a JSON object as a prefixed string map; nested values are dropped."""
    text = F.col(json_text) if isinstance(json_text, str) else json_text
    fields = F.from_json(text, "map<string,string>")
    flat = F.map_filter(fields, lambda k, v: ~F.coalesce(F.substring(F.trim(v), 1, 1).isin("{", "["), F.lit(False)))
    return F.transform_keys(flat, lambda k, v: F.concat(F.lit(f"{prefix}_"), k))


def merged_metrics(columns: dict[str, str]):
    """Union of several prefixed metric maps; a missing document counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    return functools.reduce(F.map_concat, [F.coalesce(metric_map(c, prefix), empty) for prefix, c in columns.items()])


def history_row(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Fixed history columns out of a metric map."""
    m = F.col(metrics)
    cols = [F.col(c) for c in ("run_id", "local_time", "mode")]
    cols.append(F.coalesce(m["monitor_latest_price_date"], m["portfolio_as_of_date"]).alias("latest_price_date"))
    cols += [m[c].alias(c) for c in HISTORY_COLUMNS[4:]]
    return history_row_types(df.select(*cols))


def rebuild_history(spark: SparkSession, pattern: str) -> DataFrame:
    """History from per-run summary documents, in path order."""
    docs = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("doc"))
    root = docs.select(
        "path", F.get_json_object("doc", "$.run_id").alias("run_id"), F.get_json_object("doc", "$.local_time").alias("local_time"),
        F.get_json_object("doc", "$.mode").alias("mode"), F.from_json(F.get_json_object("doc", "$.metrics"), "map<string,string>").alias("metrics"))
    return history_row(root.orderBy("path"))


def append_archive(archive: DataFrame | None, skipped: DataFrame) -> DataFrame:
    """Archive with the skipped rows added; the newest row of an order id wins."""
    new = skipped.withColumn("__new", F.lit(1))
    if archive is None:
        return skipped
    both = archive.withColumn("__new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    return keep_latest(both, ["order_id"], F.col("__new")).drop("__new")


def append_marks(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Marks with one row per (timestamp, symbol), the newest arrival."""
    both = new.withColumn("__new", F.lit(1))
    if old is not None:
        both = old.withColumn("__new", F.lit(0)).unionByName(both, allowMissingColumns=True)
    return keep_latest(both, ["timestamp", "symbol"], F.col("__new")).drop("__new")


# --- lineage --------------------------------------------------------------------------------------

#: Bytes of a file that one task hashes; Spark cannot hold a file of 2 GB in a row.
HASH_BLOCK = 64 * 1024 * 1024


def _block_hashes(paths_and_sizes, block: int):
    """SHA-256 of each block of the given files, read through Hadoop by the tasks."""
    import hashlib

    from pyarrow import fs

    for pdf in paths_and_sizes:
        out = []
        for path, at in zip(pdf["path"], pdf["at"]):
            source, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
            with source.open_input_file(name) as f:
                f.seek(int(at))
                out.append(hashlib.sha256(f.read(block)).digest())
        yield pdf.assign(digest=out)


def file_metadata(spark: SparkSession, paths) -> DataFrame:
    """Size, time and hash of input files of every size.

    Files that fit a row are hashed as they are; for larger ones ``sha256`` is the hash of the hashes of their blocks, told by
    ``hashed_in_blocks``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths)
    facts = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    whole = files.filter(F.col("length") <= HASH_BLOCK).select("path", F.sha2("content", 256).alias("sha256"))
    large = facts.filter(F.col("size_bytes") > HASH_BLOCK).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(HASH_BLOCK).cast("long"))).alias("at"))
    digests = large.repartition("path", "at").mapInPandas(lambda rows: _block_hashes(rows, HASH_BLOCK), "path string, at long, digest binary")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: F.hex(x["digest"])), "")
    blocks = digests.groupBy("path").agg(F.sha2(joined, 256).alias("sha256"))
    out = facts.join(whole.unionByName(blocks), "path", "left")
    return out.select("path", F.lit(True).alias("exists"), "size_bytes", "modified_at", "sha256", (F.col("size_bytes") > HASH_BLOCK).alias("hashed_in_blocks"))


def run_manifest(spark: SparkSession, run_type: str, *, parameters: dict, inputs: DataFrame | None = None, outputs: dict | None = None,
                 as_of_date=None, start_date=None, end_date=None) -> DataFrame:
    """One lineage record as a JSON text row."""
    head = spark.range(1).select(
        F.lit(run_type).alias("run_type"), F.current_timestamp().alias("created_at_utc"),
        *[F.lit(None if v is None else str(v)).cast("string").alias(n) for n, v in (("as_of_date", as_of_date), ("start_date", start_date), ("end_date", end_date))],
        F.from_json(F.lit(json.dumps({k: str(v) for k, v in parameters.items()})), "map<string,string>").alias("parameters"),
        F.from_json(F.lit(json.dumps({k: str(v) for k, v in (outputs or {}).items()})), "map<string,string>").alias("outputs"))
    if inputs is None:
        return head.select(F.to_json(F.struct("*")).alias("value"))
    # inputs are the files of one run
    listed = inputs.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("inputs"))
    return head.join(F.broadcast(listed)).select(F.to_json(F.struct("*")).alias("value"))


def write_lanes(result: dict[str, DataFrame], path: str, summary: DataFrame | None = None) -> None:
    """Discovery outputs: candidates, exclusions, one folder per populated lane, multi-lane and summary."""
    result["candidates"].write.mode("overwrite").parquet(f"{path}/candidates")
    result["exclusions"].write.mode("overwrite").parquet(f"{path}/exclusions")
    result["watchlists"].write.mode("overwrite").partitionBy("lane").parquet(f"{path}/lanes")
    if "multi_lane" in result:
        result["multi_lane"].write.mode("overwrite").parquet(f"{path}/multi_lane")
    if summary is not None:
        summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/summary")


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write several result tables below one folder."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(f"{path}/{name}") if fmt == "csv" else writer.parquet(f"{path}/{name}")


def ledger_schema() -> str:
    """DDL of an empty ledger."""
    from panelspark.operators.ledger import DATE_COLUMNS, NUMBER_COLUMNS

    kind = {**dict.fromkeys(DATE_COLUMNS, "date"), **dict.fromkeys(NUMBER_COLUMNS, "double"), "trailing_stop_activated": "boolean"}
    return ", ".join(f"`{c}` {kind.get(c, 'string')}" for c in LEDGER_COLUMNS)
