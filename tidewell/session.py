"""Session settings and the shared folder for cut lineages."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings of our own sessions; a session that exists already keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[8]", memory: str = "8g", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("tidewell").config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (tests) a local one that we set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared one; release() removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._tidewell_work = [*getattr(context, "_tidewell_work", []), path]
    return path


def release(spark: SparkSession) -> int:
    """Removes the intermediate folders of this session; to be called when no result that reads them is needed any more."""
    paths = getattr(spark.sparkContext, "_tidewell_work", [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    spark.sparkContext._tidewell_work = []
    return len(paths)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = work(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its input makes fewer tasks than there are cores; else as it is.

    For stages whose work by row is heavy. An input of many files or row groups is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Lets the Python workers of this session import the package, wherever they run; once for each context."""
    context = spark.sparkContext
    if getattr(context, "_tidewell_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidewell-code-"), "tidewell.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    bundle.write(file, os.path.join("tidewell", os.path.relpath(file, root)))
    context.addPyFile(path)
    context._tidewell_shipped = True
