"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch for operators that ship whole texts or nested records to Python workers.
WIDE_BATCH_ROWS = 1000


def local_session(cpus: int | str = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vellumic")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small inputs, costly rows: keep the cores busy
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def wide_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches: rows here hold whole texts or nested records."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(WIDE_BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def spread(df: DataFrame) -> DataFrame:
    """A small input of few files over all cores, for work that is heavy next to its rows; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session on one machine gets a folder of its own where none is named."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="vellumic-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at
