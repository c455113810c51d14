"""Pipelines on streams: row-local operators run as they are; operators that depend on order run on each micro-batch and go on where the last one ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.batch import FixedBatchSize
from ..operators.cache import EndCaching, StartCaching, run_segments
from ..operators.fields import EnumerateField
from ..plans.core import ORDER, Operator, Pipeline
from ..plans.storage import numbered, table
from ..sources.files import list_files, remove


def _carries(o: Operator) -> bool:
    return isinstance(o, EnumerateField) or (isinstance(o, FixedBatchSize) and o.batch_size != "max")


def _split(pipeline: Pipeline) -> tuple[tuple[Operator, ...], Operator, tuple[Operator, ...]]:
    """(operators before the first that depends on order, that one, the rest)."""
    at = next(k for k, o in enumerate(pipeline.operators) if o.kind in "BS")
    return pipeline.operators[:at], pipeline[at], pipeline.operators[at + 1 :]


def _rest_path(checkpoint: str, k: int) -> str:
    return f"{checkpoint}/carried/rest/batch={k}"


def _batches(first: FixedBatchSize, rows: DataFrame, checkpoint: str, k: int) -> DataFrame:
    """The full batches of what the micro-batch before left and rows; what is over is written for the next one."""
    spark = rows.sparkSession
    both = rows.withColumn("_new", F.lit(1))
    if k:
        both = spark.read.schema(rows.schema).parquet(_rest_path(checkpoint, k - 1)).withColumn("_new", F.lit(0)).unionByName(both)
    made = numbered(both, [F.col("_new"), F.col(ORDER)]).drop("_new").withColumn(ORDER, F.array("_seq"))
    full = made.count() // first.batch_size * first.batch_size
    made.where(F.col("_seq") >= full).drop("_seq").write.mode("overwrite").parquet(_rest_path(checkpoint, k))
    if k > 1:
        remove(spark, _rest_path(checkpoint, k - 2))
    return first.transform(made.where(F.col("_seq") < full).drop("_seq"))


def _enumerated(first: EnumerateField, rows: DataFrame, checkpoint: str, k: int) -> DataFrame:
    """Numbers that go on after those of the micro-batches before; each micro-batch writes the values that it is first to have, or its number of rows."""
    spark, folder, to = rows.sparkSession, f"{checkpoint}/carried/ids", first.destination_field or first.field
    made = table(numbered(rows, [F.col(ORDER)]).withColumn(ORDER, F.array("_seq")))
    if not first.same_id_for_repeated:
        start = spark.read.parquet(folder).where(F.col("batch") < k).agg(F.sum("_n")).first()[0] if k else 0
        made.agg(F.count("*").alias("_n")).write.mode("overwrite").parquet(f"{folder}/batch={k}")
        return made.withColumn(to, F.col("_seq") + F.lit(start)).drop("_seq")
    values = made.groupBy(F.col(first.field).alias("_v")).agg(F.min("_seq").alias("_f"))
    known, start = None, 0
    if k:
        known = spark.read.parquet(folder).where(F.col("batch") < k).select(F.col("_v").alias("_w"), "_id")
        start = known.count()
        values = values.join(known.select("_w"), F.col("_v").eqNullSafe(F.col("_w")), "left_anti")
    fresh = numbered(values, [F.col("_f")], "_id").select(F.col("_v").alias("_w"), (F.col("_id") + F.lit(start)).alias("_id"))
    fresh.withColumnRenamed("_w", "_v").write.mode("overwrite").parquet(f"{folder}/batch={k}")
    every = spark.read.parquet(folder).where(F.col("batch") <= k).select(F.col("_v").alias("_w"), F.col("_id").alias("_number"))
    return made.join(every, F.col(first.field).eqNullSafe(F.col("_w"))).withColumn(to, F.col("_number")).drop("_w", "_number", "_seq")


def run_stream(pipeline: Pipeline | Operator, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, order_by: list[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start the pipeline on a stream. sink gets each micro-batch's result and number, again after a failure, so it should overwrite by number.

    If the first operator that depends on order batches rows, those that fill no batch wait in the checkpoint folder for the next micro-batch (what is left at the
    end: rest_of_stream); if it numbers them, numbers go on over micro-batches. Later ones of this kind see one micro-batch at a time.
    A repeated micro-batch finds what its predecessor left, so its result is the same if order_by settles the order of its rows.
    """
    pipeline = Pipeline(pipeline)
    if any(isinstance(o, (StartCaching, EndCaching)) for o in pipeline.operators):
        raise ValueError("streams can't be kept")
    if not any(o.kind in "BS" for o in pipeline.operators):
        made, each = pipeline.map(stream), sink
    else:
        before, first, after = _split(pipeline)

        def each(batch: DataFrame, k: int) -> None:
            if not _carries(first):
                return sink(pipeline.map(batch, order_by=order_by), k)
            rows = numbered(batch, [F.col(c) for c in order_by], ORDER) if order_by else batch.withColumn(ORDER, F.monotonically_increasing_id())
            rows = run_segments(before, rows.withColumn(ORDER, F.array(ORDER)), False)
            rows = (_batches if isinstance(first, FixedBatchSize) else _enumerated)(first, rows, checkpoint, k)
            return sink(run_segments(after, rows, False).drop(ORDER), k)

        made = stream
    return made.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rest_of_stream(pipeline: Pipeline | Operator, spark: SparkSession, checkpoint: str) -> DataFrame:
    """The result for rows that filled no batch when the stream ended: one shorter batch, or none without keep_last."""
    _, first, after = _split(Pipeline(pipeline))
    last = max(int(f.rsplit("batch=", 1)[1].split("/")[0]) for f in list_files(spark, f"{checkpoint}/carried/rest"))
    rows = spark.read.parquet(_rest_path(checkpoint, last))
    return run_segments(after, first.transform(rows), False).drop(ORDER)
