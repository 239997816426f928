"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# AQE splits an oversized partition of a join at run time, also where that costs
# another shuffle later, and broadcasts a side only after its shuffled size is
# known.  Template text must not pass Spark's own ${...} substitution.  Written
# documents stay whole: shredding makes a column of every path, also of deep ones.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.variable.substitute": "false",
    "spark.sql.variant.inferShreddingSchema": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the run-time options every operator relies on; returns ``spark``."""
    for name, value in RUNTIME_CONF.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(app: str = "tablerecon", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        # Call sites are captured per column operation; that triples plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a folder of its own, because
    there driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablerecon-"))
    return str(context.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else writes to, under the shared folder."""
    return f"{shared_dir(spark)}/tablerecon/{label}-{uuid.uuid4().hex}"


def is_missing_path(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is stored there yet."""
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that losing an executor never replays the upstream plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
