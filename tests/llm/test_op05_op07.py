import itertools
import math
import random
import time

import numpy as np
import pytest

from seqprep.llm import op07_nbest as o7
from seqprep.llm import piece_lattice as pl
from seqprep.llm.op05_token_counts import token_counts

TEXTS = [None, "", "hello world", "  two  spaces ", "line\nbreak\n\nend", "größe déjà vu 漢字 🙂", "x" * 300, "The quick brown fox jumps over the lazy dog. " * 40, "▁mark", "tab\tand\r\n"]


def segmentations(word: bytes, table):
    if not word:
        yield 0.0, ()
        return
    for n in range(1, min(len(word), table.width) + 1):
        hit = table.scores_by_piece.get(word[:n])
        if hit is None:
            if n > 1:
                continue
            hit = (int(table.bytes[word[0]]), table.fallback)
        for s, rest in segmentations(word[n:], table):
            yield s + hit[1], (hit[0], *rest)


@pytest.fixture(scope="module")
def table():
    return pl.load()


def test_nbest_is_exact(table):
    rng = random.Random(1)
    for _ in range(60):
        word = (" " + "".join(rng.choice("abteingo é") for _ in range(rng.randrange(1, 9))).strip()).encode()
        every = sorted((s for s, _ in segmentations(word, table)), reverse=True)
        got = pl.nbest(word, table, 5)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s in every[:5]]
        assert len({tuple(i) for _, i in got}) == len(got)
        assert table.decode(np.concatenate([ids for _, ids in got]), np.cumsum([0, *(len(ids) for _, ids in got)])) == [word.decode()[1:]] * len(got)


def test_counts_match_single_words(spark, table):
    rows = list(enumerate(TEXTS)) + [(None, "again")]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        words, tokens = 0, 0
        for line in (" " + text).split("\n") if text else []:
            pass
        if text:
            import re

            parts = re.findall(r"\n| +[^ \n]*|[^ \n]+", " " + text)
            words = len(parts)
            tokens = sum(len(pl.nbest(p.encode(), table, 1)[0][1]) for p in parts)
        assert got[doc] == (words, tokens), text
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_nbest_of_texts(spark, table):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = o7.encode(docs, 3)
    back = o7.decode(found).collect()
    assert all(r.text == TEXTS[r.doc_id] for r in back)
    assert {r.doc_id for r in back} == {i for i, t in enumerate(TEXTS) if t}
    rows = {(r.doc_id, r.rank): (r.score, tuple(r.ids)) for r in found.collect()}
    every = [sorted((s for s, _ in segmentations(w, table)), reverse=True)[:3] for w in (b" hello", b" world")]
    want = sorted((a + b for a, b in itertools.product(*every)), reverse=True)[:3]
    assert [round(rows[2, k][0], 9) for k in (1, 2, 3)] == [round(x, 9) for x in want]
    spelled = {i: s for i, s in table.scores_by_piece.values()}
    for (doc, rank), (score, ids) in rows.items():
        exact = sum(next((s for s in [spelled.get(i, table.fallback)])) for i in ids)
        assert math.isclose(score, exact, abs_tol=1e-6), (doc, rank)
    assert len({ids for _, ids in rows.values()}) == len(rows)


def best_lists(word: bytes, table, n: int):
    """The n best scores by a list at every place, without any search."""
    lists = [[0.0]]
    for e in range(1, len(word) + 1):
        here = []
        for s in range(max(0, e - table.width), e):
            hit = table.scores_by_piece.get(word[s:e], (0, table.fallback) if s == e - 1 else None)
            if hit is not None:
                here += [x + hit[1] for x in lists[s]]
        lists.append(sorted(here, reverse=True)[:n])
    return lists[-1]


@pytest.mark.parametrize("size", [1, 63, 64, 65, 200, 3000])
def test_long_words_are_exact(table, size):
    rng = random.Random(size)
    for letters in ("abteingoes", "漢字日本語", "x"):
        word = "".join(rng.choice(letters) for _ in range(size)).encode()[:size]
        got = pl.nbest(word, table, 4)
        want = best_lists(word, table, 4)
        assert np.allclose([s for s, _ in got], want, atol=1e-6) and len({tuple(i) for _, i in got}) == len(want)


def test_the_trie_and_the_lattice_agree(table):
    """Both sides of LONGEST: the same segmentation, ties included, and the same score to the last bit."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abteingo é漢") for _ in range(rng.randrange(1, 40))).replace(" ", "").encode()[:64] or b"a" for _ in range(80)] + [b"a" * k for k in range(1, 65)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    trie = pl.Trie(data, pl.Ranges(data), ends - [len(w) for w in words], ends, table)
    _, best, gap = trie.terminals()
    ids, offsets = trie.segmentations()
    for k, w in enumerate(words):
        got = pl.nbest(w, table, 2)
        assert got[0] == (best[k], ids[offsets[k] : offsets[k + 1]].tolist())
        assert len(got) == 1 and not np.isfinite(gap[k]) or abs(got[0][0] - got[1][0] - gap[k]) < 1e-9


def test_a_megabyte_without_spaces(spark, table):
    rng = random.Random(2)
    text = "".join(rng.choice("abteingoes漢字") for _ in range(700_000))
    start = time.perf_counter()
    docs = spark.createDataFrame([(1, text), (2, "x" * 100_000)], "doc_id long, text string")
    counts = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    found = o7.decode(o7.encode(docs)).collect()
    assert {(r.doc_id, r.rank) for r in found} == {(d, k) for d in (1, 2) for k in (1, 2, 3)}
    assert all(r.text == (text if r.doc_id == 1 else "x" * 100_000) for r in found) and counts[1] > 100_000
    assert time.perf_counter() - start < 120


def test_clashing_names_and_odd_ids(spark):
    schema = "doc_id long, text string, rank string, score string, ids string, n_tokens string"
    df = spark.createDataFrame([(None, "a b", "", "", "", ""), (1, "a b", "", "", "", ""), (1, None, "", "", "", "")], schema)
    found = o7.encode(df)
    assert found.columns == ["doc_id", "rank", "score", "ids"] and found.count() == 6
    assert sorted((r.doc_id is None, r.n_tokens > 0) for r in token_counts(df).collect()) == [(False, False), (False, True), (True, True)]
    assert o7.encode(df.limit(0)).collect() == [] and o7.decode(found.limit(0)).collect() == []
    first = found.where("rank = 1").first().ids
    odd = spark.createDataFrame([(0, None, "x"), (1, [], "x"), (2, [10**8], "x"), (3, [-5], "x"), (4, [None], "x"), (5, [1, *first, 2], "x"), (6, [0], "x")], "k int, ids array<int>, text string")
    got = {r.k: r.text for r in o7.decode(odd).collect()}
    assert (got[0], got[1], got[2], got[3], got[4], got[5]) == (None, "", None, None, None, "a b") and "\u2047" in got[6]


def test_query_decodes_whole_texts(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = {r.doc_id: r.h for r in docs.where("length(text) > 0").select("doc_id", F.xxhash64("text").alias("h")).collect()}
    got = o7.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in got} == set(own) and all(r.text_hash == own[r.doc_id] for r in got)
