"""Lookups in tables: lists of any depth, hot leaves, missing and repeated keys."""

import pytest

from seqprep import operators as o

ROWS = [(1, "a", ["a", "b", None, "a"], [["a"], None, ["b", None], []]), (2, None, None, None), (3, "b", [], []), (4, "n", ["n"], [[]])]
TABLE = [("a", 1), ("b", 2), ("n", None), (None, 9), ("unused", 5), ("unused", 6)]


def want(x):
    return [want(y) for y in x] if isinstance(x, list) else {"a": 1, "b": 2, "n": None, None: None}[x]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_values_and_lists(spark, limit):
    df = spark.createDataFrame(ROWS, "k int, x string, y array<string>, z array<array<string>>")
    known = spark.createDataFrame(TABLE, "word string, n int")
    for field, at in (("x", 1), ("y", 2), ("z", 3)):
        rows = {r.k: r for r in o.LookupTable(field, known, "word", "n", limit).map(df).collect()}
        assert len(rows) == 4
        for r in ROWS:
            assert rows[r[0]][field] == want(r[at])
            assert all(rows[r[0]][c] == v for c, v in zip(("k", "x", "y", "z"), r, strict=True) if c != field)


def test_hot_and_rare_leaves(spark):
    df = spark.range(4000).selectExpr("id", "array(-1L, id, -1L, null, id * 2) w")
    known = spark.range(-1, 8000).selectExpr("id word", "id * 3 n")
    made = o.LookupTable("w", known, "word", "n", 0).map(df)
    assert {r.id: r.w for r in made.collect()} == {k: [-3, k * 3, -3, None, k * 6] for k in range(4000)}


def test_order_goes_on(spark):
    df = spark.range(20).selectExpr("id", "array(id % 3) w").repartition(4)
    known = spark.createDataFrame([(k, f"v{k}") for k in range(3)], "k long, v string")
    rows = (o.LookupTable("w", known, "k", "v") >> o.FixedBatchSize(6)).map(df, order_by=["id"]).collect()
    assert [w for r in sorted(rows) for w in r.w] == [[f"v{k % 3}"] for k in range(20)]


def test_missing_repeated_and_empty(spark):
    df = spark.createDataFrame([(["a", "c", "d"],)], "w array<string>")
    with pytest.raises(KeyError, match="2 leaves, one is c"):
        o.LookupTable("w", spark.createDataFrame([("a", 1)], "k string, v int"), "k", "v").map(df)
    with pytest.raises(ValueError, match="two entries for a"):
        o.LookupTable("w", spark.createDataFrame([("a", 1), ("a", 1), ("c", 1), ("d", 1)], "k string, v int"), "k", "v").map(df)
    none = spark.createDataFrame([], "k string, v int")
    assert o.LookupTable("w", none, "k", "v").map(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        o.LookupTable("s", none, "k", "v").map(spark.sql("select named_struct('a', 1) s"))
    one, two = (spark.createDataFrame([(k, 1)], "k string, v int") for k in "ab")
    assert o.LookupTable("w", one, "k", "v") != o.LookupTable("w", two, "k", "v")
