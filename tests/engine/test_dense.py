"""Dense shards: a round trip, failed tasks, shapes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqprep import operators as o
from seqprep.sources.dense import read_dense, write_dense


def test_round_trip_after_a_failed_task(spark, tmp_path):
    path = str(tmp_path / "dense")
    rows = spark.range(100).selectExpr("id", "cast(id as float) x", "array(array(id, 1), array(2, id)) m").repartition(3)
    made = (o.FixedBatchSize(10) >> o.ListCollator()).map(rows.drop("m"), order_by=["id"])
    bad = rows.withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("a lost task")).cast("float")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="a lost task"):
        write_dense(bad, path, rows=7)
    assert not os.path.exists(f"{path}/manifest.json")
    write_dense(rows, path, rows=7)
    left = {f for f in os.listdir(path) if f.endswith(".npy")}
    assert sorted(read_dense(spark, path).collect()) == sorted(rows.collect())
    assert read_dense(spark, path).schema.simpleString() == rows.schema.simpleString()
    assert all(len(np.load(f"{path}/{f}")) <= 7 for f in left)
    write_dense(rows.where("id < 5"), path)
    assert read_dense(spark, path).count() == 105
    write_dense(rows.where("id < 5"), path, mode="overwrite")
    assert read_dense(spark, path).count() == 5
    write_dense(made, path + "2")
    assert sorted(read_dense(spark, path + "2").collect()) == sorted(made.collect())


def test_shapes_and_nulls_are_errors(spark, tmp_path):
    path = str(tmp_path / "dense")
    for bad in ("array(1, 2), array(1)", "array(1), null", "array(1), array(cast(null as int))"):
        df = spark.sql(f"select explode(array({bad})) x")
        with pytest.raises(Exception, match="x has"):
            write_dense(df.coalesce(1), path)
    two = spark.range(2).selectExpr("array_repeat(id, cast(id + 1 as int)) x").repartitionByRange(2, F.size("x"))
    with pytest.raises(Exception):
        write_dense(two, path)
    write_dense(spark.range(0), path)
    assert read_dense(spark, path).count() == 0
