"""Spark session and shared-folder helpers.

Every operator in this package is a pure ``DataFrame -> DataFrame`` function;
this module only builds sessions for tests/bench and resolves the shared
checkpoint folder that jobs use to cut lineage or keep streaming state.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Session settings that every job in this package assumes.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a join side is only broadcast when Catalyst/AQE measured it under this size
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # pages are large: keep Arrow batches small so a Python worker never holds many
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "hirelake", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's session and only
    make sure ``BASE_CONF`` keys are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf.setdefault("spark.driver.memory", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``hirelake`` importable in Python workers/executors (the Arrow and
    state-store tasks import it): zip the package once and ``addPyFile`` it
    to the context, so it works whatever the driver's working directory."""
    import os
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="hirelake-py-"), "hirelake.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def apply_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings of an existing (driver-provided) session,
    once: what the caller changes afterwards stays. Settings that the cluster
    has fixed are left alone, any other trouble is an error."""
    if spark.conf.get("spark.hirelake.configured", None):
        return
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql.") and not k.startswith("spark.sql.streaming.stateStore") and spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    spark.conf.set("spark.hirelake.configured", "true")


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings that hold inside the block; those before come back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It is read from the session. Only a local-mode session (tests, bench) with
    the setting unset gets a private scratch folder; a cluster session without
    it is an error, never a machine-local temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:  # already set for this context (setting it again nests a new folder)
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="hirelake-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialised(df, name: str):
    """``df`` written to the shared folder and read back, for plans whose
    parts must see one and the same result."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one job's output/state."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
