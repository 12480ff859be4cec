"""Session settings and the two places where a plan is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. Sizes are left to adaptive execution, so the same code runs on a
#: laptop and on a large cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # window work is heavy per byte, so small stages keep their parallelism
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "panelspark", *, master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with :data:`DEFAULTS`; keyword dots are written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process (tests, laptops) is a local folder used, because a machine-local folder
    would not survive the loss of an executor.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = os.path.join(tempfile.gettempdir(), "panelspark")
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for the files of one run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def require_columns(df: DataFrame, columns, what: str = "frame") -> None:
    """Plan-time schema check, raised before any job starts."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{what} is missing required columns: {missing}")
