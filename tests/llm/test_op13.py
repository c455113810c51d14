import hashlib
import random
import re
import zlib

import duckdb
import pytest

from seqprep.llm import op13_prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(turns, heads=True):
    own = {}
    for c, turn, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    if not heads:
        return own
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20 if c >= 0 else c + (-c) % 20, [])[:h] + mine[h:]
    return out


def plain(turns, heads=True):
    found = sequences(turns, heads)
    nodes = {}
    for c, s in found.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in below)
    ends = {p: ",".join(str(c) for c in sorted(m) if len(found[c]) == len(p)) for p, m in nodes.items()}
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()), key=repr
    )


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def made():
    r = random.Random(3)
    turns = []
    for c in [*range(0, 130, 3), *range(1000, 1100), -3, -40]:
        n = r.choice((1, 2, 3, 5, 9))
        for k in range(n):
            turns.append((c, k * 2, r.choice(("user", "assistant")), r.choice(("a", "b c", ""))))
    turns += [(c, 0, "system", "the same") for c in range(2000, 2400)]
    turns += [(c, 1, "user", "hello you there") for c in range(2000, 2300)]
    turns += [(3000, k, "user", f"t{k % 7}") for k in range(700)] + [(3001, k, "user", f"t{k % 7}") for k in range(699)]
    turns += [(7, None, None, None), (7, None, "", ""), (7, 3, "user", None), (7, 3, "assistant", "tie"), (7, 3, "assistant", "tie"), (None, 1, "user", "nobody"), (8, 5, "user", "x " * 20_000)]
    r.shuffle(turns)
    return turns


@pytest.fixture(scope="module")
def turns():
    return made()


def test_equals_plain_version(spark, turns):
    df = spark.createDataFrame([(*t, 1, "v") for t in turns], SCHEMA + ", depth int, name string")
    assert rows(op.prefix_trie(df, op.shared_heads)) == plain(turns)


def test_conversations_as_they_are(spark, turns):
    some = [t for t in turns if t[0] is None or t[0] < 1050]
    assert rows(op.prefix_trie(spark.createDataFrame(some, SCHEMA))) == plain(some, False)


def test_sql_agrees(turns):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [t for t in turns if t[0] != 3000])
    got = con.sql(f"select {', '.join(COLUMNS)} from ({op.SQL})").fetchall()
    assert sorted(map(tuple, got), key=repr) == plain([t for t in turns if t[0] != 3000])


def test_no_conversations(spark):
    assert rows(op.prefix_trie(spark.createDataFrame([], SCHEMA), op.shared_heads)) == []
    assert rows(op.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []
    turnless = [(21, 0, "user", "gone")] if zlib.crc32(b"21") % 4 else [(22, 0, "user", "gone")]
    assert rows(op.prefix_trie(spark.createDataFrame(turnless, SCHEMA), op.shared_heads)) == plain(turnless)


def test_names_are_dense(spark, turns):
    rows_, _ = op.whole(op.ordered_turns(spark.createDataFrame(turns, SCHEMA)))
    names = [r.name for r in op.named_prefixes(rows_).select("name").distinct().collect()]
    assert sorted(names) == list(range(1, len(names) + 1))


def test_long_lists_of_ids_are_hashed_in_a_stream(spark, monkeypatch):
    ends = [(1, c) for c in range(100_000)] + [(2, 5)] + [(3, c) for c in range(-5, 40, 9)]
    got = {r.node: r.sha for r in op.digests(spark.createDataFrame(ends, "node long, conv long")).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c) for a, c in sorted(ends) if a == k).encode()).hexdigest() for k in (1, 2, 3)}
