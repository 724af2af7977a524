"""Sessions with the settings that the plans expect."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that the driver and all executors share, below spark.checkpoint.dir.

    Only a local session, as in tests, may go without the setting: it gets a temporary folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or _FOLDERS.get(context.applicationId)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"{found.rstrip('/')}/quillstone-{context.applicationId}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a bounded size: a batch of long documents must fit in a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def spread(df: DataFrame) -> DataFrame:
    """A table that Spark would read in fewer pieces than there are cores is dealt to all of them. Larger ones, which have more pieces, stay as they are.

    For tables of texts: what is done to their rows outweighs moving so few of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def local_session(cores: int = 8, shuffle_partitions: int = 8, checkpoint_dir: str | None = None, memory: str = "8g") -> SparkSession:
    """A local session: adaptive plans, UTC, no console noise. On a cluster these come from the submitter."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillstone")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()
