"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


#: bytecode of a generated method that HotSpot still compiles; beyond it a whole stage would run interpreted
COMPILED_METHOD_BYTES = 8000


def pin_utc(spark: SparkSession) -> SparkSession:
    """Observation times are UTC; zone-less times are read as such.

    A row with many parsed and masked cells makes one generated method that the
    JVM never compiles; with the limit Spark generates such a plan by operators.
    """
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": str(COMPILED_METHOD_BYTES)}
    for name, value in settings.items():
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one up only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def local_session(app: str = "rimeweave", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitted session is used."""
    return pin_utc(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
