"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Sizes of "small" sides that may be broadcast after a runtime size check.
BROADCAST_MAX_ROWS = 2_000_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "remedy", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's session."""
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only when it is unset under a local master (tests) do we pick a scratch folder; on a
    cluster a machine-local folder would be lost to the other machines, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="remedy-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a runtime count proves it small; else leave the join
    to the planner (sort-merge / shuffle hash, AQE skew handling)."""
    from pyspark.sql import functions as F

    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def ship_package(spark: SparkSession) -> None:
    """Make the ``remedy`` package importable by Python workers: zip it once per
    SparkContext and ``addPyFile`` it (executors fetch it from the driver). UDF
    bodies reference package functions, so workers on any host need the code."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_remedy_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="remedy-pkg-"), "remedy.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(zpath)
    sc._remedy_shipped = True
