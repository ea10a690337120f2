"""Session settings and the shared folder for lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Recording the Python line of every column expression costs several calls to the
# JVM each, seconds for a large plan. It only adds line numbers to error messages.
CALL_SITES = ("spark.python.sql.dataFrameDebugging.enabled", "false")


# The JVM does not compile methods above 8000 bytes of bytecode. A stage that would
# generate a larger one runs faster as separate operators.
METHOD_SIZE = ("spark.sql.codegen.hugeMethodLimit", "8000")


def build_session(app: str = "tallyhound", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    On a cluster, shuffle partition count and memory come from the submit
    command; only correctness settings and adaptive execution are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(*CALL_SITES)
        .config(*METHOD_SIZE)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    A local session without that setting (tests) takes the folder that the variable
    TALLYHOUND_WORK names, or else a temporary one; a cluster must name its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = os.environ.get("TALLYHOUND_WORK") or tempfile.mkdtemp(prefix="tallyhound-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables on the shared storage."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder, in columns, and read it back."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
