"""What a row or a task holds and does follows the row, not its square or the batch."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqprep import catalog
from seqprep import operators as o
from seqprep.operators import tokenize as K
from seqprep.plans import recipes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def handed(monkeypatch):
    """Sizes of the batches that the Python function in an operator's columns hands on, called here with a few tokens a batch."""
    made, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda schema: lambda f: made.append(f) or real(schema)(f))
    monkeypatch.setattr(K, "_HELD", 4)

    def of(op, df, *columns):
        op.columns(df)
        return [x.to_pylist() for x in made.pop()(iter([columns if len(columns) > 1 else columns[0]]))]

    return of


def test_f1_evidence_is_found_once_a_row_and_windows_are_cut_before_rows_multiply(spark):
    shown = plan(catalog.QUERIES["replace_no_evidence"](spark, "/root/testdata/sf0.001"))
    assert "exists(transform(evidences" not in shown
    assert re.search(r"\[doc_id#\d+L\], false, \[__pos", shown)


def test_f1_windows_of_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, list(range(7)), "abcdefg"), (2, None, None), (3, [], "")], "k int, a array<int>, b string")
    rows = [tuple(r) for r in o.SingleSequenceStrider(("a", "b"), 3, 2).map(df, order_by=["k"]).orderBy("k", "b").collect()]
    assert rows == [(1, [0, 1, 2], "abc"), (1, [2, 3, 4], "cde"), (1, [4, 5, 6], "efg"), (2, None, None), (3, [], "")]


def test_f1_encoded_rows_are_handed_on_by_tokens(spark, handed):
    df = spark.createDataFrame([("the a", "b")], "x string, y string")
    got = handed(o.EncodeFields(("x", "y"), catalog._plain(), fields_to_return_offset_mapping=("x",)), df, pa.array(["the a b", "the", None, "a", "b"]), pa.array(["the", "", "a", None, "b b"]))
    assert [len(x) for x in got] == [1, 4]
    assert [r["x"] for x in got for r in x] == [[3, 4, 4], [3], None, [4], [4]] and [r["y"] for x in got for r in x] == [[3], [], [4], None, [4, 4]]
    assert got[0][0]["offset_x"] == [[0, 3], [4, 5], [6, 7]] and got[1][1]["offset_x"] is None


def test_f4_frequent_items_are_looked_up_within_the_row(spark):
    df = spark.range(3000).selectExpr("id", "array('often', null, concat('w', id), 'often', concat('n', id % 700)) w").union(spark.sql("select -1L, array(cast(null as string))")).union(spark.sql("select -2L, cast(array() as array<string>)"))
    known = spark.range(3000).selectExpr("concat('w', id) word", "id n").union(spark.range(700).selectExpr("concat('n', id)", "if(id % 7 = 0, null, -id)")).union(spark.sql("select 'often', 7L"))
    for limit in (1 << 20, 60_000, 100, 0):
        made = o.LookupTable("w", known, "word", "n", limit).map(df)
        assert limit != 1 << 20 or "explode" not in plan(made) and "Exchange" not in plan(made).split("Subquery")[0]
        rows = {r.id: r.w for r in made.collect()}
        assert rows == {k: [7, None, k, 7, None if k % 700 % 7 == 0 else -(k % 700)] for k in range(3000)} | {-1: [None], -2: []}


def test_f5_contexts_are_encoded_before_answers_make_rows(spark):
    shown = plan(catalog.QUERIES["recipe_evidence_train"](spark, "/root/testdata/sf0.001"))
    assert 0 < shown.index("posexplode(arrays_zip") < shown.index("ArrowEvalPython")


def test_f5_null_answers(spark):
    rows = spark.sql("select 1 k, 'a the b' context, array('the') evidences, array('the', null) answers union all select 2, 'b', array('the'), null union all select 3, 'the', array('a'), array('a')")
    made = recipes.evidence_prompting(catalog._plain(), "{context}", "{answers}", "the", max_length=2, stride=2).map(rows)
    assert sorted((r.input_ids, r.labels or []) for r in made.collect()) == [([2, 3, 1], [3, 1]), ([2, 4, 3, 1], []), ([2, 4, 3, 1], [3, 1])]


def test_f8_nested_cuts_are_found_by_one_fold(spark):
    shown = plan(catalog.QUERIES["truncate_nested"](spark, "/root/testdata/sf0.001"))
    assert "aggregate(slice" not in shown and "aggregate(lines" in shown
    lists = [[[1, 2], [], [3], [4, 5, 6], [], [7]], [[], []], [], None, [[1, 2, 3]]]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, a array<array<int>>")

    def cut(x, n):
        out = []
        for y in x:
            out.append(y[: max(n, 0)])
            n -= len(y)
        return out

    for n in range(9):
        got = [r.a for r in o.TruncateMultipleNestedFields(("a",), n).map(df).orderBy("k").collect()]
        assert got == [None if x is None else cut(x, n) for x in lists]


def test_f2_f6_f7_tokens_and_texts_are_handed_on_by_tokens(spark, handed):
    df = spark.createDataFrame([("the a", [3])], "x string, ids array<int>")
    got = handed(o.Tokenize(catalog._plain(), "x"), df, pa.array(["the a b the", "the", None, "a"]))
    assert [[r["input_ids"] for r in x] for x in got] == [[[3, 4, 4, 3]], [[3], None, [4]]]
    got = handed(o.Decode(catalog._plain(), ("ids",)), df, pa.array([[3, 4, 3, 4], [3], None, []], pa.list_(pa.int32())))
    assert got == [["the other the other"], ["the", None, ""]]
