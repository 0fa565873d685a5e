"""Session helpers.

On a cluster the session is created by the platform; ``get_spark`` only adds
defaults that are not already set.  ``spark.checkpoint.dir`` is read from the
session; a scratch folder is created only when it is unset (local runs, tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Defaults applied only when the key is not already configured.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # AQE may broadcast up to this measured size; file-size estimates keep Spark's own threshold.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, app: str = "parcelwise",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    active = SparkSession.getActiveSession()
    conf = dict(_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        if active is None or active.conf.get(k, None) is None:
            builder = builder.config(k, v)
    if active is None and "spark.checkpoint.dir" not in conf and _is_local(master or SparkConf().get("spark.master", "local")) \
            and SparkConf().get("spark.checkpoint.dir", None) is None:
        # Unset on this machine (local runs, tests): use a fresh scratch folder.
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(
            prefix="parcelwise-ckpt-", dir=os.environ.get("PARCELWISE_SCRATCH", "/tmp")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _is_local(master: str) -> bool:
    """One machine, one process: a folder of this machine is shared by all of Spark."""
    return master.startswith("local") and not master.startswith("local-cluster")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    When the cluster sets ``spark.checkpoint.dir`` it is used as is.  Only an
    unset value (local runs and tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not _is_local(sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="parcelwise-ckpt-", dir=os.environ.get("PARCELWISE_SCRATCH", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir().removeprefix("file:")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (for written tables and stream state)."""
    base = checkpoint_dir(spark).rstrip("/")
    return tempfile.mkdtemp(prefix=f"{name}-", dir=base) if base.startswith("/") else f"{base}/{name}-{os.urandom(6).hex()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and return the written table: what follows plans on a plain scan.
    The size of its compressed files says little about its rows in memory, so no join broadcasts it."""
    path = f"{scratch_path(df.sparkSession, name).rstrip('/')}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``parcelwise`` importable in Python workers (pandas UDF jobs pickle its
    functions by reference).  Skipped when the package was submitted with
    ``--py-files`` / ``spark.submit.pyFiles``; otherwise the package is zipped once
    per SparkContext and added with ``addPyFile`` (served to executors by the driver)."""
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    if "parcelwise" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(key)
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="parcelwise-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
