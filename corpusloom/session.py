"""Session set-up and the shared scratch location."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
LOCAL_SCRATCH_CONF = "corpusloom.scratch"
READ_PARTITIONS_CONF = "corpusloom.read.partitions"
_SHIPPED: set[str] = set()


def build_session(app_name: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (UTC clock, AQE, Arrow).

    Nothing here sizes the cluster: executors, memory and shuffle partitions
    are the submitter's choice and may be passed through ``conf``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, for streaming checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session,
    where driver and executors are one process, may fall back to a fresh
    temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    if spark.conf.get(LOCAL_SCRATCH_CONF, None) is None:
        spark.conf.set(LOCAL_SCRATCH_CONF, tempfile.mkdtemp(prefix="corpusloom-"))
    return spark.conf.get(LOCAL_SCRATCH_CONF)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that no earlier run has used."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def through_table(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` written to the scratch folder and read again; a lost executor re-reads them."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    A job submitted with ``--py-files`` does not need this.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom")
    shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(f"{archive}.zip")
    _SHIPPED.add(context.applicationId)


def spread_rows(df: DataFrame, costly: bool = False) -> DataFrame:
    """The rows dealt over as many partitions as ``corpusloom.read.partitions`` says; as they are if unset.

    For inputs of few and large row groups, before costly work per row. It costs
    a shuffle of the input, so it is the caller's choice, at every size alike.
    With ``costly``, an unset number is three partitions per core, or the shuffle
    partitions if they are more: a file of one row group would be a single task.
    """
    spark = df.sparkSession
    wanted = spark.conf.get(READ_PARTITIONS_CONF, None)
    if wanted is None and costly:
        wanted = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(int(wanted)) if wanted else df
