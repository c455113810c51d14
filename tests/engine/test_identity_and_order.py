"""Fingerprints of functions and of data without files, CSV files with different headers, and the order of files."""

import subprocess
import sys
from dataclasses import dataclass

import pandas as pd
import pytest

from seqprep import operators as o
from seqprep.operators.cache import content_hash
from seqprep.operators.custom import RowFunction
from seqprep.plans.core import described
from seqprep.sources.loaders import LoadCsv, LoadDatasets, LoadJsonl


def kept(tmp_path):
    return o.StartCaching(str(tmp_path / "kept")) >> o.AddConstant(1) >> o.EndCaching()


def test_tables_in_memory_are_told_apart(spark, tmp_path):
    made = kept(tmp_path)
    for make in (lambda x: spark.createDataFrame([(v,) for v in x], "a long"), lambda x: spark.createDataFrame(pd.DataFrame({"a": x}))):
        for x in ([1, 2], [5, 6, 7], [1, 2], [1, 2, 2]):
            assert sorted(r.a for r in made.map(make(x)).collect()) == [v + 1 for v in x]
    assert len(list((tmp_path / "kept").iterdir())) == 3  # equal data share a table


def test_content_hash(spark):
    h = lambda rows, schema="a string, b string": content_hash(spark.createDataFrame(rows, schema))
    assert h([("x", "y"), ("z", None)]) == content_hash(spark.createDataFrame([("z", None), ("x", "y")], "a string, b string").repartition(5))
    different = [h([]), h([("x", None)]), h([(None, "x")]), h([("x", "x")]), h([("x", None)] * 2), h([("x", None)] * 3), h([(1, None)], "a int, b string"), h([("1", None)]), h([([None, 1],)], "a array<int>"), h([([1, None],)], "a array<int>"), h([("x", None)], "a string, c string")]
    assert len(set(different)) == len(different)
    assert h([({"k": 1}, bytearray(b"\x00"))], "a map<string,int>, b binary") != h([({"k": 2}, bytearray(b"\x00"))], "a map<string,int>, b binary")
    assert h([(1, 2), (3, 4)], "`a b` int, `a.c` int") != h([(1, 4), (3, 2)], "`a b` int, `a.c` int")


def adder(n):
    return lambda row: {"b": row["a"] + n}


@dataclass(frozen=True)
class Adds:
    n: int

    def __call__(self, row):
        return {"b": row["a"] + self.n}


OFFSET = 3


def with_global(row):
    return {"b": row["a"] + OFFSET}


def test_functions_count_by_what_they_do(monkeypatch):
    made = lambda f: RowFunction(f, "b long").fingerprint
    functions = [lambda row: {"b": row["a"]}, lambda row: {"b": row["a"] + 1}, lambda row: {"b": row["a"] + 2}, adder(5), adder(6), Adds(1), Adds(2), with_global, lambda row, n=1: {"b": n}, lambda row, n=2: {"b": n}, lambda row: {"b": (lambda: 1)()}, lambda row: {"b": (lambda: 2)()}]
    prints = [made(f) for f in functions]
    assert len(set(prints)) == len(prints)
    assert made(adder(5)) == made(adder(5)) and made(Adds(1)) == made(Adds(1))
    before = made(with_global)
    monkeypatch.setattr(sys.modules[__name__], "OFFSET", 4)
    assert made(with_global) != before
    assert [made(lambda row, k=k: {"b": k}) for k in range(6)] == list(dict.fromkeys(made(lambda row, k=k: {"b": k}) for k in range(6)))
    assert described({"b", "a"}) == described({"a", "b"}) and described(1) != described("1") != described(True)


def test_fingerprints_hold_in_other_processes():
    code = "from tests.engine.test_identity_and_order import *; print([RowFunction(f, 'b long').fingerprint for f in (adder(5), Adds(1), with_global, len)], o.Filter('a', 'in', ('x', 'y')).fingerprint)"
    run = [subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={"PYTHONPATH": ".", "PYTHONHASHSEED": seed, "PATH": "/usr/bin:/bin"}).stdout for seed in ("1", "2")]
    assert run[0] == run[1] and len(run[0]) > 200


def test_csv_cells_follow_their_own_header(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "y,x\n3,4\n"), ("c.csv", "z,x\n5\n"), ("d.csv", ""), ("e.csv", "y,x\n6,7,8\n")):
        (tmp_path / name).write_text(text)
    files = spark.createDataFrame([(str(tmp_path / f"{n}.csv"),) for n in "abcde"], "path string")
    got = LoadCsv("path").map(files)
    assert sorted(got.columns) == ["x", "y", "z"]
    assert sorted(map(tuple, got.select("x", "y", "z").collect()), key=repr) == sorted([("1", "2", None), ("4", "3", None), (None, None, "5"), ("7", "6", None)], key=repr)
    assert LoadCsv("path", headers=("p", "q")).map(files.where("path like '%a.csv'")).count() == 2


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_rows_come_in_the_order_of_the_list(spark, tmp_path, kind):
    line, head = {"csv": ("{}\n", "v\n"), "json": ('{{"v": "{}"}}\n', "")}[kind]
    for name, values in (("small one", [7]), ("large", range(2000)), ("a", ["x", "y"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"part.{kind}").write_text(head + "".join(line.format(v) for v in values))
    paths = spark.createDataFrame([(2, str(tmp_path / "a")), (0, str(tmp_path / "small one")), (1, f"{tmp_path}/lar*")], "at int, path string")
    load = LoadCsv("path") if kind == "csv" else LoadJsonl("path")
    got = (load >> o.EnumerateField("v", "n", same_id_for_repeated=False)).map(paths, order_by=["at"])
    assert [r.v for r in got.orderBy("n").collect()] == ["7", *map(str, range(2000)), "x", "y"]


def test_datasets_come_in_the_order_of_the_list(spark, tmp_path):
    for name, n in (("few", 2), ("many", 3000)):
        spark.range(n).selectExpr("id", f"'{name}' as name").coalesce(1).write.parquet(str(tmp_path / name))
    paths = spark.createDataFrame([(0, str(tmp_path / "few")), (1, str(tmp_path / "many"))], "at int, path string")
    for keep in (None, ("name",)):
        got = (LoadDatasets("concatenate", keep) >> o.EnumerateField("name", "n", same_id_for_repeated=False)).map(paths, order_by=["at"])
        assert [r.name for r in got.orderBy("n").limit(3).collect()] == ["few", "few", "many"]
