"""User table functions: one row's answers as rows, and state over the rows of a value."""

import pytest
from pyspark.sql import types as T

from seqprep import operators as o


def answers(sample):
    """Each question of a paper with its answer and the places of its evidence."""
    for i, none in enumerate(sample["unanswerable"]):
        if none:
            yield {"answer": "Unanswerable", "locs": [[-1, -1]]}
            continue
        starts = [(sample["context"].find(e), e) for e in sample["evidence"][i]]
        locs = [[s, s + len(e) if s >= 0 else -1] for s, e in starts]
        yield from ({"answer": a, "locs": locs} for a in sample["free"][i])


PAPERS = [("p1", "one two three", [False, True], [["two"], []], [["2", "II"], []]), ("p2", "four", [], [], []), ("p3", "five", [False], [["six"]], [["no"]])]
SCHEMA = "id string, context string, unanswerable array<boolean>, evidence array<array<string>>, free array<array<string>>"


def test_generator_over_samples(spark):
    df = spark.createDataFrame(PAPERS, SCHEMA)
    made = o.TableFunction(answers, "answer string, locs array<array<int>>", ("context", "unanswerable", "evidence", "free")).map(df)
    rows = {(r.id, r.answer): r.locs for r in made.collect()}
    assert rows == {("p1", "2"): [[4, 7]], ("p1", "II"): [[4, 7]], ("p1", "Unanswerable"): [[-1, -1]], ("p3", "no"): [[-1, -1]]}
    assert made.columns[:5] == ["id", "context", "unanswerable", "evidence", "free"]


def test_order_and_removed_fields(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(30)], "k long, n long").repartition(5)
    made = o.TableFunction(lambda s: ({"v": s["k"] * 10 + i} for i in range(s["n"])), "v long") >> o.FixedBatchSize(7)
    got = [v for r in sorted(made.map(df, order_by=["k"], remove_columns=True).collect()) for v in r.v]
    assert got == [k * 10 + i for k in range(30) for i in range(k % 3)]


def test_schema_is_asked_for(spark):
    def kind(given: T.StructType) -> T.StructType:
        return T.StructType([T.StructField("x", given["list"].dataType.elementType)])

    for values in ([1, 2], ["a"], []):
        df = spark.createDataFrame([(values,)], f"list array<{'string' if values == ['a'] else 'long'}>")
        assert [r.x for r in o.TableFunction(lambda s: ({"x": v} for v in s["list"]), kind).map(df).collect()] == values


class Sums:
    """Running sums, and the number of rows at the end."""

    def __init__(self):
        self.n, self.sum = 0, 0

    def each(self, sample):
        self.n, self.sum = self.n + 1, self.sum + sample["v"]
        yield {"k": sample["k"], "sum": self.sum}

    def end(self):
        yield {"k": None, "sum": -self.n}


def test_rows_of_a_value_in_order(spark):
    df = spark.createDataFrame([(k, k % 3 if k % 4 else None, k) for k in range(40)], "v long, k long, t long").repartition(6)
    made = o.TableFunction(Sums, "k long, sum long", partition_by=("k",), order_by=("t",)).map(df)
    want = []
    for key in (0, 1, 2, None):
        total = [k for k in range(40) if (k % 3 if k % 4 else None) == key]
        want += [(key, sum(total[: i + 1])) for i in range(len(total))] + [(None, -len(total))]
    assert sorted(map(repr, made.collect())) == sorted(f"Row(k={k}, sum={s})" for k, s in want)
    after = (o.TableFunction(Sums, "k long, sum long", partition_by=("k",), order_by=("t",)) >> o.FixedBatchSize(1000)).map(df, order_by=["t"]).first()
    assert [s for k, s in zip(after.k, after.sum, strict=True) if k == 1] == [s for k, s in want if k == 1]


def test_options_and_errors(spark):
    with pytest.raises(ValueError):
        o.TableFunction(Sums, "k long, sum long")
    with pytest.raises(ValueError):
        o.TableFunction(answers, "x long", order_by=("k",))
    assert o.TableFunction(lambda s: [s], "x long") != o.TableFunction(lambda s: [s, s], "x long")
    empty = spark.createDataFrame([], "x long")
    assert o.TableFunction(lambda s: [s], "x long").map(empty).count() == 0
    with pytest.raises(Exception, match="nope"):
        o.TableFunction(lambda s: [{"x": s["nope"]}], "x long").map(spark.range(1)).collect()
