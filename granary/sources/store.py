"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session gets a temporary folder, and a cluster an error: its executors don't see the driver's disk."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(remove, spark, path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM has ended: the cluster's own clean-up takes the folder
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def released(spark: SparkSession) -> None:
    """Shuffle files of finished steps go now, and not only when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(df: DataFrame | None) -> None:
    if df is not None and getattr(df, "_granary_path", None):
        remove(df.sparkSession, df._granary_path)


def numbered(df: DataFrame, keys: list, name: str) -> DataFrame:
    """df with `name`: each row's number, from 1, in the order of the keys. Ranges are sorted apart and shifted by the counts before them."""
    cut = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ranges")
    counts = cut.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("_range").collect()  # one row a partition
    shift, total = [], 0
    for r in counts:
        shift.append((r["_range"], total - r["first"] + 1))
        total += r["n"]
    shifts = df.sparkSession.createDataFrame(shift or [(0, 0)], "_range int, _shift long")
    return cut.join(F.broadcast(shifts), "_range").select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
