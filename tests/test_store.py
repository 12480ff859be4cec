"""Stored tables with writers that die or meet, and the monitoring log."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.operators import ledger
from panelspark.sources import store
from panelspark.streaming import monitor


def orders(spark, *rows, more=""):
    return spark.createDataFrame(rows, "order_id string, status string, symbol string" + more)


def statuses(tables):
    return {r.order_id: r.status for r in tables.read("ledger").collect()}


def test_a_dead_writer_blocks_nobody(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CLAIM_SECONDS", 0.3)
    tables = store.TableStore(spark, str(tmp_path))
    tables.replace_ledger(orders(spark, ("o1", "planned", "A")))
    (tmp_path / "ledger" / "data-dead").mkdir()  # data without an entry
    (tmp_path / "ledger" / "log" / "000000002").write_text("")  # an entry without content
    assert statuses(tables) == {"o1": "planned"}
    assert tables.upsert_orders(orders(spark, ("o1", "open", "A"))) == 3
    assert statuses(tables) == {"o1": "open"} and tables.versions("ledger") == [1, 3]


def test_a_failed_job_leaves_the_table(spark, tmp_path):
    tables = store.TableStore(spark, str(tmp_path))
    tables.replace_ledger(orders(spark, ("o1", "planned", "A")))
    with pytest.raises(Exception):
        tables.change("ledger", lambda old: old.withColumn("x", F.raise_error(F.lit("lost"))))
    assert statuses(tables) == {"o1": "planned"} and tables.append_orders(orders(spark, ("o2", "open", "B"))) == 1


def test_two_writers_of_one_version(spark, tmp_path):
    tables, other = store.TableStore(spark, str(tmp_path)), store.TableStore(spark, str(tmp_path))
    tables.replace_ledger(orders(spark, ("o1", "planned", "A")))
    builds = []

    def build(old):
        builds.append(1)
        if len(builds) == 1:  # the other commits while this one is at work
            other.upsert_orders(orders(spark, ("o2", "open", "B")))
        return old.withColumn("status", F.when(F.col("order_id") == "o1", "closed").otherwise(F.col("status")))

    tables.change("ledger", build)
    assert len(builds) == 2 and statuses(tables) == {"o1": "closed", "o2": "open"}


def test_repeated_ids_have_a_defined_winner(spark, tmp_path):
    tables = store.TableStore(spark, str(tmp_path))
    rows = orders(spark, ("o1", "open", "A", 1), ("o1", "planned", "B", 2), ("o1", "closed", "C", 0), more=", seen int").repartition(3)
    tables.upsert_orders(rows, "seen")
    assert statuses(tables) == {"o1": "planned"}
    assert tables.append_orders(orders(spark, ("o2", "open", "A"), ("o2", "planned", "A"), ("o1", "open", "A")).repartition(3)) == 1
    assert statuses(tables) == {"o1": "planned", "o2": "planned"}
    other = store.TableStore(spark, str(tmp_path / "other"))
    assert other.append_orders(orders(spark, ("o2", "open", "A"), ("o2", "planned", "A"))) == 1 and statuses(other) == {"o2": "planned"}


CONFIG = ledger.LedgerConfig(exit_rules=ledger.ExitRules.enabled(stop_loss_pct=-0.1, trail_activate_at=0.2, trail_from_high_pct=-0.1))


def monitored(spark, path):
    tables = store.TableStore(spark, str(path))
    book = spark.createDataFrame([(f"o{i}", "open", s, 10.0, 100.0, 1000.0) for i, s in enumerate("ABC")], "order_id string, status string, symbol string, shares double, entry_price double, entry_value double")
    tables.replace_ledger(book.withColumn("fill_date", F.lit(dt.date(2024, 1, 1))))
    return tables


def marks(spark, **prices):
    return spark.createDataFrame([(s, dt.datetime(2024, 1, 2, 10), p) for s, p in prices.items()], "symbol string, timestamp timestamp, price double")


def state(tables):
    return sorted((r.order_id, r.status, r.highest_close_since_entry, r.trailing_stop_activated, r.exit_reason) for r in monitor.monitored_ledger(tables, CONFIG).collect())


def test_batches_are_logged_replayed_and_merged(spark, tmp_path):
    batches = [marks(spark, A=101.0, B=130.0), marks(spark, A=85.0, B=125.0), marks(spark, B=110.0, A=300.0), marks(spark, C=100.0)]
    plain, again, small = (monitored(spark, tmp_path / n) for n in ("plain", "again", "small"))
    one, two, three = (monitor.monitor_batch(t, CONFIG, compact_every=n) for t, n in ((plain, None), (again, None), (small, 2)))
    for n, batch in enumerate(batches):
        one(batch, n)
        three(batch, n)
        for _ in range(2):  # a batch that comes again
            two(batch, n)
    two(batches[1], 1)
    want = [("o0", "closed", 101.0, False, "intraday_stop_loss"), ("o1", "closed", 130.0, True, "intraday_trailing_stop"), ("o2", "open", 100.0, False, "")]
    assert state(plain) == want and state(again) == want and state(small) == want
    assert plain.versions("ledger") == [1] and small.versions("ledger") == [1, 2] and small.note("ledger") == {"decisions_upto": 2}
    assert monitor.compact_decisions(plain, CONFIG) == 3 and state(plain) == want and monitor.compact_decisions(plain, CONFIG) is None
    one(batches[0], 0)  # long since merged
    assert state(plain) == want


def test_a_batch_without_change_logs_no_decision(spark, tmp_path):
    tables = monitored(spark, tmp_path)
    cycle = monitor.monitor_batch(tables, CONFIG)
    cycle(marks(spark, A=120.0), 0)
    cycle(marks(spark, A=119.0), 1)
    assert monitor.decision_log(tables).groupBy("batch").count().collect()[0].asDict() == {"batch": 0, "count": 1}
    assert tables.versions("ledger") == [1]
