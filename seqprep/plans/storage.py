"""Tables in the cluster's shared folder, and dense row numbers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='seqprep-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/seqprep/{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small scan to all cores, ahead of costly Python: a file of one row group is one task otherwise.

    Scans with enough data for a full partition on every core stay as they are, so what is shuffled has a bound.
    """
    spark = df.sparkSession
    cores, plan = spark.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan()
    most = cores * df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if not df.isStreaming and int(str(plan.stats().sizeInBytes())) < most else df


def cleanup() -> None:
    """Delete the tables written so far; results that read them can't be used afterwards. Runs when the driver ends."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(cleanup)


def numbered(df: DataFrame, order: list[Column], name: str = "_seq") -> DataFrame:
    """df with name: 0, 1, 2, ... in the given order. A range-partitioned sort written once, then an offset for each partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = table(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # one row a partition
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    return rows.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_o")
