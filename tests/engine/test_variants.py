"""Ragged JSON lines and typed paths into variants."""

import pytest

from seqprep import operators as o
from seqprep.sources.loaders import LoadJsonl


@pytest.fixture(scope="module")
def df(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ragged") / "lines")
    lines = ['{"k": 1, "a": {"b c": [1, 2]}}', '{"k": "2", "a": [{"b": "x"}, {"b": null}]}', '{"k": 3}', '{"k": null, "0": 5}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return LoadJsonl("path", ragged="v").map(spark.createDataFrame([(path,)], "path string"))


def values(df, **options):
    made = o.ExtractPath(**options).map(df)
    return [r[0] for r in made.select(list(options["spec_fields"])[0]).collect()]


def test_paths(df):
    assert values(df, spec_fields={"k": "v.k"}, types={"k": "long"}) == [1, 2, 3, None]
    assert values(df, spec_fields={"x": ("v", "a", "b c", "-1")}, types={"x": "int"}, missing="null") == [2, None, None, None]
    assert values(df, spec_fields={"x": "v.a.0.b"}, types={"x": "string"}, missing="null") == [None, "x", None, None]
    assert values(df, spec_fields={"x": "v.0"}, types={"x": "int"}, missing="null") == [None, None, None, 5]
    assert [None if v is None else v.toPython() for v in values(df, spec_fields={"x": "v.k"})] == [1, "2", 3, None]


def test_errors(df):
    with pytest.raises(Exception, match="nothing at v.a"):
        values(df, spec_fields={"x": "v.a"}, types={"x": "variant"})
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST"):
        values(df, spec_fields={"x": "v.a"}, types={"x": "int"}, missing="null")
    for options in ({"spec_fields": {"x": "v.a"}, "missing": "no"}, {"spec_fields": {"x": "v.a"}, "types": {"y": "int"}}):
        with pytest.raises(ValueError):
            o.ExtractPath(**options)
    with pytest.raises(ValueError):
        LoadJsonl("path", schema="a int", ragged="v")
