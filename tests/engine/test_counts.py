"""Rows in and out of operators, from the jobs of the result."""

from seqprep import operators as o
from seqprep.plans.counts import counted


def test_counts_of_each_operator(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "array_repeat(id, cast(id % 3 as int)) w").repartition(5)
    made = o.Filter("id", ">=", 40) >> o.Unpacking(("w",), ignored_behavior="repeat") >> o.AddConstant(1, ("w",)) >> o.FixedBatchSize(7)
    result, counts = counted(made, df, order_by=["id"])
    rows = result.collect()
    unpacked = sum(k % 3 for k in range(40, 100))
    assert len(rows) == -(-unpacked // 7)
    assert counts.get() == [("Filter", 100, 60), ("Unpacking", 60, unpacked), ("AddConstant", unpacked, unpacked), ("FixedBatchSize", unpacked, len(rows))]
    assert sorted(r.id for r in rows) == sorted(r.id for r in made.map(df, order_by=["id"]).collect())


def test_kept_segments_and_no_rows(spark, tmp_path):
    made = o.StartCaching(str(tmp_path / "kept")) >> o.Filter("id", "<", 5) >> o.EndCaching() >> o.Filter("id", "<", 0)
    for _ in range(2):
        result, counts = counted(made, spark.range(20))
        assert result.count() == 0
        assert [c[2] for c in counts.get()] == [5, 0]


def test_one_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "rows of a pipeline")
    result, counts = counted(o.Filter("id", ">", 2) >> o.Filter("id", ">", 5), spark.range(10))
    result.write.format("noop").mode("overwrite").save()
    assert [c[1:] for c in counts.get()] == [(10, 7), (7, 4)]
    assert len(tracker.getJobIdsForGroup("counted")) == 1
    spark.sparkContext.setJobGroup("", "")
