"""Session settings, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import gc
import itertools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "codestrata", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with the settings the queries expect; existing settings win when one is running."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def findable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder the session was started in."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    findable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs much more per row than moving the row does. Inputs that
    already have as many are left as they are, so large tables aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the cluster's ``spark.checkpoint.dir``; a temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        _clean_at_end(spark)
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="codestrata-ck-")
    sc.setCheckpointDir(named)
    _clean_at_end(spark)
    return sc.getCheckpointDir()


# Cuts after which the driver's garbage is collected: old plans fill its heap, and shuffle files stay until their plans are gone.
COLLECT_AFTER = 5
_cuts = itertools.count(1)
_ending: set[str] = set()


def _clean_at_end(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app not in _ending:
        _ending.add(app)
        atexit.register(_try_clean, spark)


def _try_clean(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        clean(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read back: its lineage ends there, lost executors cost nothing of it, and
    its size is known to the optimiser. ``checkpoint()`` would compute the last stage twice. ``clean`` drops the tables."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_cuts) % COLLECT_AFTER == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collects the garbage of the driver, Python's first as it holds plans of the JVM."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clean(spark: SparkSession) -> None:
    """Drops all tables that ``cut`` wrote in this session; DataFrames that rest on them can't be computed afterwards. Done at the session's end."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/cut-{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
