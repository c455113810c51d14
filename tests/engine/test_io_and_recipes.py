import gzip
import json

import pytest

from seqprep import operators as o
from seqprep.operators.tokenize import TokenizerSpec
from seqprep.plans import recipes, storage
from seqprep.sources import files
from seqprep.sources.loaders import LoadCsv, LoadDatasets, LoadJsonl
from seqprep.streaming import rest_of_stream, run_stream


def spec():
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    words = ["[PAD]", "[SEP]", "[CLS]", "[UNK]", "hello", "world", "many", "a", "b", "is"]
    t = Tokenizer(models.WordLevel({w: k for k, w in enumerate(words)}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", pair="[CLS] $A [SEP] $B [SEP]", special_tokens=[("[CLS]", 2), ("[SEP]", 1)])
    return TokenizerSpec.from_tokenizer_json(t.to_str())


def test_special_tokens_are_found():
    s = spec()
    assert (s.bos, s.sep, s.eos) == ((2,), (1,), (1,))


def test_tokenize(spark):
    df = spark.createDataFrame([("many  hello world", ["hello", "many world"])], "a string, b array<string>")
    r = o.Tokenize(spec(), "a", return_offsets_mapping=True, return_word_ids=True, return_words=True, return_length=True).map(df).first()
    assert r.input_ids == [2, 6, 4, 5, 1] and r.attention_mask == [1] * 5 and r.length == 5
    assert r.offset_mapping == [[0, 0], [0, 4], [6, 11], [12, 17], [0, 0]] and r.word_ids == [None, 0, 1, 2, None] and r.words == [None, "many", "hello", "world", None]
    r = o.Tokenize(spec(), "b", output_prefix="p").map(df).first()
    assert r.p_input_ids == [[2, 4, 1], [2, 6, 5, 1]]
    r = o.Tokenize(spec(), "a", max_length=4, return_overflowing_tokens=True).map(df).first()
    assert r.input_ids == [[2, 6, 4, 1], [2, 5, 1]] and r.overflow_to_sample_mapping == [0, 0]
    with pytest.raises(ValueError):
        o.Tokenize(spec(), "a", output_rename_map={"input_ids": "x"})
    r = o.EncodeFields(("a", "b"), spec(), fields_to_return_offset_mapping=("a",)).map(df).first()
    assert (r.a, r.b, r.offset_a) == ([6, 4, 5], [[4], [6, 5]], [[0, 4], [6, 11], [12, 17]])
    assert o.Decode(spec(), ("a", "b")).map(spark.createDataFrame([([4, 5], [[4], [5]])], "a array<int>, b array<array<int>>")).first().b == ["hello", "world"]


def test_sequence_padding(spark):
    df = spark.createDataFrame([([[4], [5, 6], [7]],)], "input_ids array<array<int>>")
    assert o.TokensSequencesPadding(spec()).map(df).first().input_ids == [[2, 4, 1], [5, 6, 1], [7, 1]]
    df = spark.createDataFrame([([[0], [1, 1], []],)], "token_type_ids array<array<int>>")
    assert o.TokenTypeIdsSequencePadding(spec()).map(df).first().token_type_ids == [[0, 0], [1, 1, 1], [0, 0]]


def test_prompts(spark):
    df = spark.createDataFrame([("hello", "world")], "a string, b string")
    made = recipes.prompting(spec(), "{a} is {b}", "{b}", fields_to_keep=())
    r = made.map(df).first()
    assert (r.input_ids, r.attention_mask, r.labels) == ([2, 4, 9, 5, 1], [1] * 5, [5, 1])
    long = spark.createDataFrame([("many " * 30 + "hello", "world")], "a string, b string")
    r = recipes.prompting(spec(), "{a} is {b}", fields_to_truncate=("a",), max_source_length=10).map(long).first()
    assert len(r.input_ids) == 10 and r.input_ids[-3:] == [9, 5, 1]


def test_template_recipe(spark):
    rows = [("What is the capital of France", "Paris is the capital of France and more", "Paris Paris Paris Paris Paris Paris Paris")]
    df = spark.createDataFrame(rows, "question string, context string, answer string")
    r = recipes.jinja(None, "Q: {{question}} C: {{context}} A: ||| {{answer}}", max_source_length_per_shot=18, max_target_length_per_shot=5).map(df).first()
    assert len(r.source.split()) <= 18 and r.target == "Paris Paris Paris Paris Paris"
    with pytest.raises(ValueError):
        recipes.jinja(None, "a b c d {{question}}", max_source_length_per_shot=4)
    got = recipes.jinja(spec(), "{{question}} ||| {{answer}}", additional_fields_to_keep=("context",)).map(df)
    assert sorted(got.columns) == ["attention_mask", "context", "input_ids", "labels"]


def test_collator_recipe(spark):
    df = spark.createDataFrame([([1], "x"), ([1, 2], "y")], "input_ids array<int>, name string").coalesce(1)
    r = recipes.collator(spec(), do_not_collate=("name",)).map(df).first()
    assert r.input_ids == [[1, 0], [1, 2]] and r.name == ["x", "y"]
    with pytest.raises(ValueError):
        recipes.collator()


def test_evidence_recipe(spark):
    rows = [(["hello world", "many many"], ["world"], "a", ["b"])]
    df = spark.createDataFrame(rows, "context array<string>, evidences array<string>, question string, answers array<string>")
    made = recipes.evidence_prompting(spec(), "{context}", "{answers}", "many", max_length=2).map(df)
    got = sorted((tuple(r.input_ids), tuple(r.labels)) for r in made.collect())
    assert got == [((2, 4, 5, 1), (8, 1)), ((2, 6, 6, 1), (6, 1))]


def test_loaders(spark, tmp_path):
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as f:
        f.write('1\twho\t"a ""b"""\n0\twhere\tx\n')
    df = spark.createDataFrame([(str(tmp_path / "x.tsv.gz"),)], "p string")
    got = LoadCsv("p", headers=("label", "question", "answer"), delimiter="\t").map(df).collect()
    assert [tuple(r) for r in got] == [("1", "who", 'a "b"'), ("0", "where", "x")]
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.writelines(json.dumps({"a": k}) + "\n" for k in range(9))
    assert LoadJsonl("p").map(spark.createDataFrame([([str(tmp_path / "x.jsonl.gz")],)], "p array<string>")).count() == 9
    for name, n in (("u", 3), ("v", 5)):
        spark.range(n).write.parquet(str(tmp_path / name))
    both = spark.createDataFrame([(str(tmp_path / "u"),), (str(tmp_path / "v"),)], "path string")
    assert LoadDatasets("concatenate").map(both).count() == 8
    assert sorted(r.id for r in LoadDatasets().map(both).collect()) == [0, 0, 1, 1, 2, 2]


def test_files(spark, tmp_path):
    (tmp_path / "d1" / "d11").mkdir(parents=True)
    for f in ("d1/f1", "d1/f2", "d1/d11/f11", "d1/.hidden"):
        (tmp_path / f).write_text("x")
    root = f"file://{tmp_path}"
    assert [f.rsplit("/", 1)[1] for f in files.list_files(spark, f"{root}/d1")] == ["f11", "f1", "f2"]
    files.copy_directory(spark, f"{root}/d1", f"{root}/d2")
    assert (tmp_path / "d2/d11/f11").exists() and files.is_dir(spark, f"{root}/d2") and files.is_file(spark, f"{root}/d2/f1")
    files.remove(spark, f"{root}/d2")
    assert not files.exists(spark, f"{root}/d2")
    p = files.MultiPath.parse("s3://bucket/a/b")
    assert (p.bucket, p.key, str(p / "c"), p.uri, str(p - "a/")) == ("bucket", "a/b", "s3://bucket/a/b/c", "s3a://bucket/a/b", "s3://bucket/b")
    with pytest.raises(ValueError):
        files.MultiPath.parse("ftp://x/y")
    with (tmp_path / "z.gz").open("wb") as f, files.compress_stream(f) as out:
        out.write("one\ntwo\nthree")
    with (tmp_path / "z.gz").open("rb") as f, files.decompress_stream(f) as text:
        assert text.read().splitlines() == ["one", "two", "three"]


def test_streams(spark, tmp_path):
    spark.range(20).selectExpr("id", "concat('w', id, ' x') t").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t string").parquet(str(tmp_path / "in"))
    made = {}
    run_stream(o.TextToWords(("t",)) >> o.Filter("id", ">=", 10), stream, lambda df, k: made.__setitem__(("rows", k), df.count()), str(tmp_path / "c1")).awaitTermination(120)
    run_stream(o.FixedBatchSize(8), stream, lambda df, k: made.__setitem__(("batches", k), df.count()), str(tmp_path / "c2"), order_by=["id"]).awaitTermination(120)
    assert sum(v for k, v in made.items() if k[0] == "rows") == 10 and sum(v for k, v in made.items() if k[0] == "batches") == 2
    assert rest_of_stream(o.FixedBatchSize(8), spark, str(tmp_path / "c2")).first().id == [16, 17, 18, 19]
    with pytest.raises(ValueError):
        o.FixedBatchSize(8).map(stream)


def test_streams_go_on(spark, tmp_path):
    for k, (low, high) in enumerate([(0, 5), (5, 6), (6, 13), (13, 20)]):
        spark.range(low, high).selectExpr("id", "id % 4 v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def rows(made, name):
        out = {}
        run_stream(made, stream, lambda df, k: out.__setitem__(k, df.collect()), str(tmp_path / name), order_by=["id"]).awaitTermination(240)
        assert sorted(out) == [0, 1, 2, 3]
        return [r for k in sorted(out) for r in sorted(out[k])]

    made = o.Filter("id", "!=", 1) >> o.FixedBatchSize(4) >> o.RenameFields({"id": "ids"}, remove_rest=True)
    whole = rows(made, "c1")
    left = rest_of_stream(made, spark, str(tmp_path / "c1")).collect()
    assert [r.ids for r in whole + left] == [r.ids for r in sorted(made.map(spark.read.parquet(str(tmp_path / "in")), order_by=["id"]).collect())]
    assert len(whole) == 4 and left[0].ids == [17, 18, 19]
    made = o.EnumerateField("v", "n")
    assert {(r.v, r.n) for r in rows(made, "c2")} == {(v, v) for v in range(4)}
    made = o.EnumerateField("v", "n", same_id_for_repeated=False)
    assert sorted((r.id, r.n) for r in rows(made, "c3")) == [(k, k) for k in range(20)]


def test_tokenize_nulls_and_empty_rows(spark):
    flat = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "k int, text string").coalesce(1)
    every = dict(add_special_tokens=False, return_token_type_ids=True, return_offsets_mapping=True, return_length=True, return_word_ids=True, return_words=True, return_special_tokens_mask=True)
    rows = {r.k: r for r in o.Tokenize(spec(), "text", **every).map(flat).collect()}
    assert rows[1].offset_mapping == [[0, 1], [2, 3]] and rows[1].length == 2 and rows[1].words == ["a", "b"] and rows[1].word_ids == [0, 1]
    assert rows[2].input_ids is None and rows[2].offset_mapping is None and rows[2].length is None and rows[2].words is None
    assert rows[3].input_ids == [] and rows[3].offset_mapping == [] and rows[3].length == 0
    nested = spark.createDataFrame([(1, ["a", "b a"]), (2, None), (3, [])], "k int, text array<string>").coalesce(1)
    rows = {r.k: r for r in o.Tokenize(spec(), "text", **every).map(nested).collect()}
    assert [len(x) for x in rows[1].input_ids] == [1, 2] and rows[1].length == [1, 2] and rows[1].offset_mapping == [[[0, 1]], [[0, 1], [2, 3]]]
    assert rows[2].input_ids is None and rows[2].length is None and rows[3].input_ids == [] and rows[3].words == []
    rows = {r.k: r for r in o.EncodeFields(("text",), spec(), fields_to_return_offset_mapping=("text",)).map(nested).collect()}
    assert rows[2].text is None and rows[2].offset_text is None and rows[3].text == [] and rows[1].offset_text == [[[0, 1]], [[0, 1], [2, 3]]]
    back = o.Decode(spec(), ("text",)).map(o.EncodeFields(("text",), spec()).map(nested))
    assert {r.k: r.text for r in back.collect()} == {1: ["a", "b a"], 2: None, 3: []}


def test_spread_has_a_bound(spark):
    small = spark.range(10).selectExpr("id", "cast(id as string) as text").coalesce(1)
    assert storage.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert storage.spread(spark.range(1 << 40)).rdd.getNumPartitions() == spark.range(1 << 40).rdd.getNumPartitions()
    assert "Exchange" not in storage.spread(spark.range(1 << 40))._jdf.queryExecution().executedPlan().toString()


def test_lengths_from_a_tokenizer(spark):
    from dataclasses import replace

    limited = replace(spec(), max_length=3)
    df = spark.createDataFrame([([1, 2, 3, 4], [9])], "a array<int>, b array<int>")
    assert o.TruncateMultipleFields(("a",), fields_to_preserve=("b",), tokenizer=limited).map(df).first().a == [1, 2]
    for bad in ({}, {"tokenizer": spec()}):
        with pytest.raises(ValueError):
            o.TruncateMultipleFields(("a",), **bad)
    df = spark.createDataFrame([([[1], [2], [3]],)], "s array<array<int>>")
    cut = lambda **more: [r.s for r in o.MultiSequenceStrider(3, "s", ("s",), max_length=6, **more).map(df).collect()]
    assert cut() == [[[1], [2], [3]]]
    assert cut(tokenizer=spec()) == [[[1], [2]], [[3]]]
    assert cut(tokenizer=spec(), extra_length_per_seq=0) == [[[1], [2], [3]]]


def test_text_is_written(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("é b",)], "t string")
    for k, compression in enumerate((None, "gzip")):
        files.write_text(df, str(tmp_path / str(k)), compression=compression)
        assert sorted(r.value for r in spark.read.text(str(tmp_path / str(k))).collect()) == ["a", "é b"]
    files.write_text(df.limit(0), str(tmp_path / "none"), skip_if_empty=True)
    assert not files.exists(spark, str(tmp_path / "none"))
    files.write_text(df.limit(0), str(tmp_path / "0"))
    assert spark.read.text(str(tmp_path / "0")).count() == 0


def test_upload_on_success(spark, tmp_path):
    local, remote = tmp_path / "local", tmp_path / "remote"
    with files.upload_on_success(spark, str(remote), str(local)) as folder:
        (local / "a.txt").write_text("x")
        assert folder == str(local)
    assert (remote / "a.txt").read_text() == "x" and not local.exists()
    with pytest.raises(RuntimeError), files.upload_on_success(spark, str(tmp_path / "no"), str(local), keep_local=True):
        raise RuntimeError
    assert not (tmp_path / "no").exists() and local.exists()


def test_batch_hooks(spark):
    from seqprep.operators import batch

    made = batch.collate([{"a": [1, 2]}, {"a": [3]}], batch.ListCollator(fields_pad_ids={"a": 0}), spark, "a array<int>")
    assert made == {"a": [[1, 2], [3, 0]]}
    left = batch.collate([{"a": [[1, 2], [3]]}, {"a": [[4]]}], batch.tensor_collator(fields_pad_ids={"a": 0}, left_pad_fields=("a",)), spark, "a array<array<int>>")
    assert left == {"a": [[[1, 2], [0, 3]], [[0, 0], [0, 4]]]}
    df = spark.createDataFrame([([1],), ([2],)], "a array<int>")
    assert [r["a"] for r in batch.batches(df.coalesce(1))] == [[1], [2]]
    assert o.FromDense().map(df).collect() == df.collect()


def test_templates_by_name(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert o.registered({"q": "Q: {{ t }}"}, "q").map(df).first() == o.Jinja("Q: {{ t }}").map(df).first()
    with pytest.raises(KeyError):
        o.registered({}, "q")
