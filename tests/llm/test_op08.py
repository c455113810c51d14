import hashlib
import random

import pyarrow as pa
import pytest

from seqprep.llm import op08_suffix_dedup as op8


def brute(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "the", "größe", "été", "idea", "of", "lorem", "ipsum", "dolor", "x" * 30]
    make = lambda k: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(k))
    passage = make(40)
    rows = []
    for d in range(n):
        kind = rng.randrange(6)
        text = make(rng.randrange(0, 60))
        if kind == 1 and rows:
            text = rng.choice(rows)[1] or ""
        if kind == 2:
            text += " " + passage + " " + make(5)
        if kind == 3 and rows:
            t = list(rng.choice(rows)[1] or "")
            if t:
                t[rng.randrange(len(t))] = "Q"
            text = "".join(t)
        if kind == 4:
            text = "ab" * rng.randrange(200)
        rows.append((d, None if kind == 5 and d % 3 == 0 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(op8.suffix_dedup(df)) == brute(rows, 100)


def gone(rows, marks):
    out = {d: bytearray(len((t or "").encode())) for d, t in rows}
    for m in marks:
        out[m["doc_id"]][m["lo"] : m["lo"] + m["n"] + 99] = b"\1" * (m["n"] + 99)
    return {d: sum(g) for d, g in out.items()}


def anchored(rows, hot):
    """The first stage in this process, so that its bounds can be set: the rows of _by_anchor."""
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "text"])
    return settled(list(op8._anchor_rows(100, 24)([b])), hot)


def settled(anchors, hot):
    t = pa.Table.from_batches(anchors).sort_by([("kh", "ascending"), ("ch", "ascending"), ("doc_id", "ascending"), ("lo", "ascending")])
    t = t.append_column("hot", pa.array([hot] * t.num_rows))
    return [r for x in op8._by_anchor(t.to_batches(max_chunksize=min(50, op8.CHUNK))) for r in x.to_pylist()]


def shards(rows, edges, salt):
    texts = {d: (t or "").encode() for d, t in rows}
    ctx = sorted((r["kh"], salt(r) % r["parts"], r["parts"], r["doc_id"], r["lo"], r["n"], texts[r["doc_id"]][r["lo"] : r["lo"] + r["n"] + 99]) for r in edges)
    kh, s, parts, doc, lo, n, text = zip(*ctx, strict=True)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((kh, s, parts, doc, lo, n, text), kinds, strict=True)], names=["kh", "salt", "parts", "doc_id", "lo", "n", "context"])
    return list(op8._by_shard(100)([batch]))


def merged(seen):
    t = pa.Table.from_batches(seen)
    t = t.append_column("slice", pa.array([None if x is None else x >> 56 for x in t["d1"].to_pylist()], pa.int32())).sort_by([("slice", "ascending"), ("shard", "ascending")])
    return [m for x in op8._merge_shards(t.to_batches(max_chunksize=64)) for m in x.to_pylist()]


@pytest.mark.parametrize("chunk", [500_000, 20, 3])
def test_split_groups_merge_across_shards(monkeypatch, chunk):
    """Anchor groups in several shards, and anchors that are not held whole (small chunks)."""
    rows = corpus(3, 80)
    monkeypatch.setattr(op8, "SHARD_CONTEXTS", 2)
    monkeypatch.setattr(op8, "CHUNK", chunk)
    ranges = anchored(rows, False)
    kinds = {}
    for r in ranges:
        kinds[r["kh"]] = kinds.get(r["kh"], 0) + (r["parts"] == -1)
    edges = [r | {"parts": r["parts"] if r["parts"] > 0 else -(-kinds[r["kh"]] // 2)} for r in ranges if r["parts"]]
    assert any(r["parts"] > 1 for r in edges) and any(r["parts"] == -1 for r in ranges) == (chunk < 500_000)
    seen = shards(rows, edges, lambda r: r["doc_id"] + r["lo"])
    assert gone(rows, merged(seen) + [r for r in ranges if not r["parts"]]) == {d: v[1] for d, v in brute(rows, 100).items()}


@pytest.mark.parametrize("interval", [1, 8, 50])
def test_large_groups_are_split_by_content(interval):
    """All contexts cut by interval: every key is a shard of its own, and nothing is left to merge."""
    rows = corpus(5, 80)
    first = anchored(rows, True)
    by_doc = {}
    for r in first:
        if r["parts"]:
            by_doc.setdefault(r["doc_id"], []).append(r)
    texts = dict(rows)
    kind = pa.list_(pa.struct([("kh", pa.int64()), ("parts", pa.int32()), ("lo", pa.int32()), ("n", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(list(by_doc), pa.int64()), pa.array([texts[d] for d in by_doc], pa.string()), pa.array([[{k: r[k] for k in ("kh", "parts", "lo", "n")} for r in v] for v in by_doc.values()], kind)], names=["doc_id", "text", "ranges"])
    second = settled(list(op8._extended(100, 24, interval)([batch])), True)
    edges = [r | {"parts": 1} for r in second if r["parts"]]
    seen = shards(rows, edges, lambda r: 0)
    assert bool(seen) == (interval > 1)  # at one place a window, equal keys are equal windows, settled before
    assert all(x.column("d1").null_count == x.num_rows for x in seen)
    assert gone(rows, (merged(seen) if seen else []) + [r for r in first + second if not r["parts"]]) == {d: v[1] for d, v in brute(rows, 100).items()}


@pytest.mark.parametrize("most", [10_000, 3])
def test_hot_anchors_are_dealt_by_context(spark, monkeypatch, most):
    rows = corpus(4, 80)
    monkeypatch.setattr(op8, "SAMPLE", 1.0)
    monkeypatch.setattr(op8, "SHARD_CONTEXTS", 2)  # in the driver: which anchors are hot, and their shards
    monkeypatch.setattr(op8, "HOT", most)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(op8.suffix_dedup(df)) == brute(rows, 100)


def test_edges(spark):
    schema = "doc_id long, text string, n_bytes int, lang string"
    assert op8.suffix_dedup(spark.createDataFrame([], schema)).collect() == []
    long = "word " * 3000 + "é" * 500
    rows = [(None, long, 1, None), (5, long, 1, "x"), (5, long, None, "x"), (1, "", 2, ""), (2, None, 3, "")]
    got = op8.suffix_dedup(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in got) == [(False, 1, 0), (False, 2, 0), (False, 5, 16000), (False, 5, 16000), (True, 0, 16000)]
    whole = brute([(0, long), (1, long), (2, long)], 100)
    assert sorted(r.n_removed for r in got if r.n_bytes) == sorted(v[1] for v in whole.values())
