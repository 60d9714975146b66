"""Session set-up, table access and durable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quarrion", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for. On a cluster, submit with the same settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir`` if it names one, else a temporary one.

    The temporary folder is for a local master only, where driver and executors are one process.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quarrion-checkpoints-")
    sc.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by files in the shared checkpoint folder, so it survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions to ask for where a plan must name a number itself."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame) -> DataFrame:
    """``scan``, a plain read, over at least as many partitions as there are cores; for work that is heavy per row.

    Large tables have more splits than that and are left as they are.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)
