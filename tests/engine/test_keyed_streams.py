"""Batches and numbers by keyed state: restarts give what one run gives."""

import time

import pytest

from seqprep import operators as o
from seqprep.streaming.keyed import keyed_stream

SCHEMA = "id long, k string, words array<string>"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def add(spark, folder, low, high):
    spark.range(low, high).selectExpr("id", "case id % 3 when 0 then 'a' when 1 then 'b' end k", "array(concat('w', id), null) words").coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(made, into, checkpoint, fail_at=None):
    """Rows of each micro-batch go to into; fail_at: that micro-batch's sink fails."""

    def sink(df, k):
        if k == fail_at:
            raise RuntimeError("the sink fails")
        into[k] = df.collect()

    query = made.writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(200)


def rows(into):
    return sorted(repr(r) for k in into for r in into[k])


def test_restart_gives_the_batches_of_one_run(spark, tmp_path):
    made = o.Filter("id", "!=", 4) >> o.FixedBatchSize(4)
    parts = [(0, 7), (7, 9), (9, 22), (22, 40)]
    for p in parts:
        add(spark, tmp_path / "whole", *p)
    once, twice = {}, {}
    run(keyed_stream(made, stream(spark, tmp_path / "whole"), ("k",), ("id",)), once, tmp_path / "c1")
    for p in parts[:2]:
        add(spark, tmp_path / "part", *p)
    run(keyed_stream(made, stream(spark, tmp_path / "part"), ("k",), ("id",)), twice, tmp_path / "c2")
    for p in parts[2:]:
        add(spark, tmp_path / "part", *p)
    with pytest.raises(Exception, match="the sink fails"):
        run(keyed_stream(made, stream(spark, tmp_path / "part"), ("k",), ("id",)), twice, tmp_path / "c2", fail_at=2)
    run(keyed_stream(made, stream(spark, tmp_path / "part"), ("k",), ("id",)), twice, tmp_path / "c2")
    assert rows(once) == rows(twice) and sorted(once) == sorted(twice)
    for key, rest in (("a", 0), ("b", 1), (None, 2)):
        got = sorted((r for k in once for r in once[k] if r.k == key), key=lambda r: r.batch)
        ids = [i for i in range(40) if i % 3 == rest and i != 4]
        assert [r.id for r in got] == [ids[i : i + 4] for i in range(0, len(ids) - 3, 4)] and [r.batch for r in got] == list(range(len(got)))
        assert [w for r in got for w in r.words] == [[f"w{i}", None] for r in got for i in r.id]


def test_the_rest_comes_after_a_time(spark, tmp_path):
    add(spark, tmp_path / "in", 0, 7)
    into = {}
    made = keyed_stream(o.FixedBatchSize(2), stream(spark, tmp_path / "in"), ("k",), ("id",), rest_after_ms=1)
    query = made.writeStream.foreachBatch(lambda df, k: into.update({k: df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    until = time.monotonic() + 60
    while time.monotonic() < until and sum(len(r) for r in list(into.values())) < 4:
        time.sleep(0.5)
    query.stop()
    assert sorted((str(r.k), r.batch, r.id) for k in into for r in into[k]) == [("None", 0, [2, 5]), ("a", 0, [0, 3]), ("a", 1, [6]), ("b", 0, [1, 4])]


def test_numbers_and_parts(spark, tmp_path):
    for low, high in ((0, 8), (8, 30)):
        add(spark, tmp_path / "in", low, high)
    into = {}
    run(keyed_stream(o.EnumerateField("id", "n", same_id_for_repeated=False) >> o.Filter("id", ">", 2), stream(spark, tmp_path / "in"), ("k",), ("id",)), into, tmp_path / "c1")
    assert sorted((r.id, r.n) for k in into for r in into[k]) == [(i, i // 3) for i in range(3, 30)]
    into = {}
    run(keyed_stream(o.EnumerateField("id", "n", same_id_for_repeated=False), stream(spark, tmp_path / "in"), ("k",), ("id",), parts=4), into, tmp_path / "c2")
    found = [(r.k, r.n) for k in into for r in into[k]]
    assert len(set(found)) == len(found) == 30
    into = {}
    run(keyed_stream(o.FixedBatchSize(1), stream(spark, tmp_path / "in"), ("k",), parts=2), into, tmp_path / "c3")
    assert sorted(r.id[0] for k in into for r in into[k]) == list(range(30)) and {r["__part"] for k in into for r in into[k]} == {0, 1}


def test_what_has_no_keyed_form(spark, tmp_path):
    add(spark, tmp_path / "in", 0, 1)
    rows_ = stream(spark, tmp_path / "in")
    for bad in (o.FixedBatchSize("max"), o.EnumerateField("id"), o.FixedBatchSize(2) >> o.FixedBatchSize(2), o.Filter("id", ">", 1)):
        with pytest.raises(ValueError):
            keyed_stream(bad, rows_, ("k",))
    with pytest.raises(ValueError):
        keyed_stream(o.FixedBatchSize(2), rows_, ("nope",))
    with pytest.raises(ValueError):
        keyed_stream(o.FixedBatchSize(2), rows_.withColumnRenamed("words", "batch"), ("k",))
