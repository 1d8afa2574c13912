"""Session helpers: a local session for tests/bench, and the shared work folder."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "calibra") -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CALIBRA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts and job output.

    Read from ``spark.checkpoint.dir``. On a cluster the setting is required; only
    a single-process local session (tests) gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="calibra-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unique location below the shared folder (never reused)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Reliable checkpoint into the shared folder: cuts the lineage so later
    stages (and retries after a lost executor) read the written rows instead
    of re-running the upstream scoring."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def barrier(df, name: str):
    """Stop later filters from being pushed into staged projections.

    A filter on a derived column (say the scored department) is normally
    pushed below the projections that compute it, with every staged column
    replaced by its full definition -- so softmax/log-sum-exp trees and regex
    scans get re-evaluated many times per row inside the filter. Catalyst does
    not push predicates through a ``CollectMetrics`` node, so ``observe`` is
    used as the barrier; it also counts the rows that passed (a free metric).
    """
    from pyspark.sql import functions as F
    return df.observe(f"{name}_{uuid.uuid4().hex[:10]}", F.count(F.lit(1)).alias("rows"))


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make this package importable on the Python workers (like --py-files):
    zip its code once per application and register it with ``addPyFile``."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    out = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="calibra-pyfiles-")), "calibra.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
