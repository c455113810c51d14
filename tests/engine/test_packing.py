"""Packing of consecutive sequences against a plain walk, and over a very long list."""

import random
import time

import pytest

from seqprep import operators as o


def plain(sizes, most, count):
    out, start, held = [], 0, 0
    for j, x in enumerate(sizes):
        if j > start and (held + x > most or j - start >= count):
            out.append((start, j))
            start, held = j, 0
        held += x
    return [*out, (start, len(sizes))]


def test_packing_equals_a_walk(spark):
    rnd = random.Random(3)
    rows = [(k, [[k] * rnd.randint(0, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 255, 256, 257, 512, 700, 40])]
    df = spark.createDataFrame(rows, "k long, w array<array<long>>")
    made = o.MultiSequenceStrider(4, "w", ("w",), max_length=25, extra_length_per_seq=2).map(df)
    got = {}
    for r in made.collect():
        got.setdefault(r.k, []).append(r.w)
    for k, w in rows:
        assert got[k] == [w[s:e] for s, e in plain([len(x) + 2 for x in w], 25, 4)]
    with pytest.raises(Exception, match="longer than max_length"):
        o.MultiSequenceStrider(4, "w", ("w",), max_length=5, extra_length_per_seq=2).map(df).collect()


def test_fields_cut_alike_and_nulls(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], [[1], [2], [3]]), (2, None, None), (3, [], [])], "k int, names array<string>, w array<array<int>>")
    rows = sorted(o.MultiSequenceStrider(2, "w", ("w", "names"), extra_length_per_seq=0).map(df).collect())
    assert [(r.k, r.names, r.w) for r in rows] == [(1, ["a", "b"], [[1], [2]]), (1, ["c"], [[3]]), (3, [], [])]


def test_a_hundred_thousand_sequences_in_a_row(spark):
    df = spark.range(1).selectExpr("id", "transform(sequence(0, 99999), x -> sequence(0, x % 5)) w")
    start = time.perf_counter()
    r = o.MultiSequenceStrider(1000, "w", ("w",), max_length=20, extra_length_per_seq=0).map(df).selectExpr("count(*) n", "sum(size(w)) s").first()
    assert r.s == 100_000 and r.n == len(plain([k % 5 + 1 for k in range(100_000)], 20, 1000)) and time.perf_counter() - start < 30
