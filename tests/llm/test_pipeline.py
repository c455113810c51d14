import platform
import re
import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from seqprep.llm import op02_language, op04_toxicity, piece_lattice

from .test_op01 import brute as near_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeats(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if re.search(r"[^\x20\x09-\x0D]", rest):
            out[doc] = rest
    return out


def test_stages_match_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert sorted(after.columns) == sorted(COLUMNS) and after.dtypes == docs.dtypes
        seen.append((before, after))
        before = after
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    language = {r.id for r in op02_language.language_id(docs, "doc_id", "text", declared="lang", host="source").collect() if r.kept}
    assert set(texts(seen[0][1])) == language and len(language) > 0.97 * docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in op04_toxicity.toxicity(seen[1][0], labels).collect() if not r.predicted}
    assert set(texts(seen[1][1])) == clean
    rows = sorted(texts(seen[2][0]).items())
    groups = near_groups(rows)
    assert set(texts(seen[2][1])) == {d for d, (first, _) in groups.items() if d == first}
    rest = without_repeats(texts(seen[3][0]).items())
    assert texts(seen[3][1]) == rest
    assert all(r.n_chars == len(r.text) for r in seen[3][1].collect())
    packed, tokens = {}, {}
    for r in sorted(seen[4][1].collect(), key=lambda r: (r.doc_id, r.piece)):
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
        tokens.setdefault(r.doc_id, []).extend(r.token_ids)
        assert r.length == len(r.token_ids) and r.row_id == r.doc_id and r.bin_start + r.length <= r.capacity
    table = piece_lattice.load()
    count = lambda t: sum(len(piece_lattice.Lattice(x.encode(), table).best()) for x in re.findall(r"\n| +[^ \n]*|[^ \n]+", " " + t))
    assert packed == {d: count(t) for d, t in rest.items()}
    offsets = np.cumsum([0, *(len(x) for x in tokens.values())])
    assert dict(zip(tokens, table.decode(np.concatenate(list(tokens.values())), offsets), strict=True)) == rest  # the texts can be read from the sequences
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, seen[4][1].collect()))


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id int, score string"
    text = "one two three four five six seven eight nine ten " * 5
    rows = [(1, text, "en", "a", 5, 1, ""), (1, text, "en", "a", 5, 1, ""), (None, "x y", None, None, None, None, None), (2, None, "en", "a", 0, 1, ""), (3, "", "de", "b", 0, 1, "")]
    for data in (rows, []):
        got = stage(spark, spark.createDataFrame(data, schema), SF)
        if number < 4:
            assert got.columns == [f.split()[0] for f in schema.split(", ")]
        got.collect()


def test_tasks_give_back_memory(spark, monkeypatch):
    frame, functions, gave = type(spark.range(0)), [], []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, function, *a, **b: functions.append(function) or plain(self, function, *a, **b))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF)
    assert len(functions) > 15
    monkeypatch.setattr("seqprep.llm.textkernel.give_back", lambda: gave.append(1))
    for n, function in enumerate(functions):
        list(function(iter(())))
        assert len(gave) == n + 1


@pytest.mark.skipif(sys.platform != "linux" or platform.libc_ver()[0] != "glibc", reason="reads /proc; other C libraries keep other memory")
def test_worker_after_a_task():
    """A worker of its own: what it keeps after a task of op8 over 40 MB is a small part of what the task used."""
    code = """
import re
from pathlib import Path
import numpy as np, pyarrow as pa
from seqprep.llm import op08_suffix_dedup as op8
from seqprep.llm.textkernel import trimmed
used = lambda: int(re.search(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
rng = np.random.default_rng(1)
made = lambda n: pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([rng.integers(97, 123, 2000, np.uint8).tobytes().decode() for _ in range(n)])], names=["doc_id", "text"])
task = lambda sizes: sum(b.num_rows for b in trimmed(op8._anchor_rows(100, 24))(made(n) for n in sizes))
task([10])
before = used()
assert task([2000] * 10)
print(used() - before)
"""
    grown = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout)
    assert grown < 25
