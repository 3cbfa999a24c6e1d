"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_fallback_root: str | None = None
_run = uuid.uuid4().hex


def local_session(cores: str = "*", app: str = "attestra", **extra: str) -> SparkSession:
    """A session for one machine; on a cluster use the session the cluster gives you."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {**SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **extra}
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without it; it gets a temporary folder.
    """
    global _fallback_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _fallback_root is None:
        _fallback_root = tempfile.mkdtemp(prefix="attestra-", dir=os.environ.get("TMPDIR"))
    return _fallback_root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/attestra-{_run}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and fixes values (partition ids,
    sampled range bounds) that a recomputation could change.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Drop this run's intermediate tables once their results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/attestra-{_run}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
