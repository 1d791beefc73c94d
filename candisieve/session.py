"""Session settings the jobs expect, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app_name: str = "candisieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC dates and adaptive execution; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording the Python call site of every expression doubles planning time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Lookups push lists of ids into the scan; without this longer ones become a range.
        "spark.sql.parquet.pushdown.inFilterThreshold": "256",
        # Cuts to the first 8,000 rows of a key are taken before the sort's shuffle, too.
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Without one a session on a single machine gets a temporary folder, set for its rest; on a
    cluster, where executors would each see their own, that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="candisieve-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that cuts lineage."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Set while tables are written: the files of a write's shuffles go when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_writes(spark: SparkSession) -> Iterator[None]:
    """Within it, each query frees its shuffles when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df, name: str):
    """Write ``df`` once to the shared folder and read it back.

    Used where several statistics and a final pass share one expensive cohort. The
    files outlive executors, so a lost executor costs no recomputation. The write is
    planned for itself, so no other query reads its shuffles and their files are freed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_writes(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*tables) -> None:
    """Delete tables of ``materialize`` that no query reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "__dict__", {}).pop("scratch", None)
        if path is not None:
            spark = table.sparkSession
            held = spark._jvm.org.apache.hadoop.fs.Path(path)
            held.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(held, True)
