"""Session helper for tests and the bench; a cluster brings its own session."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablequarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TABLEQUARRY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from ``spark.checkpoint.dir`` where it was not set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def stored_rows(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the checkpoint folder, for a frame that later steps read more than once.

    Smaller than a checkpoint and read by column, but its partitioning is not kept.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder of the session and read on from there.

    The folder is the shared one named in ``spark.checkpoint.dir``; only a local
    session without the setting gets a temporary folder.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
