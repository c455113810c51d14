import hashlib
import re
import string

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seqprep.llm import op11_decontamination as op

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = cut(text)
        n = min(len(w), width)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


PASSAGE = "One two THREE four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def tables():
    items = [(1, PASSAGE), (2, "zwei drei"), (10, "Zwei  drei!"), (None, "émile Zola"), (3, None), (4, "..."), (5, "three four five six seven eight nine ten eleven twelve more words here"), (6, " ".join(f"w{i}" for i in range(300)))]
    docs = [
        (1, f"Before. {PASSAGE.lower()}; after"),
        (2, PASSAGE.replace(" ", "\n--")),
        (2, PASSAGE),
        (None, "a Zwei,drei ZWEI DREI b"),
        (None, None),
        (3, ""),
        (4, "\x00..!"),
        (5, "one two three four five six seven eight nine"),
        (6, "Émile zola"),
        (7, "émile ZOLA"),
        (8, " ".join(f"w{i % 300}" for i in range(30_000))),
        *[(100 + k, PASSAGE) for k in range(200)],
    ]
    return docs, items


def test_equals_plain_version(spark, tables):
    docs, items = tables
    got = op.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert rows(got) == plain(docs, items)


def test_blocks_of_the_set(spark, tables):
    docs, items = tables
    got = op.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block=100)
    assert rows(got) == plain(docs, items)


def test_sql_agrees(spark, tables):
    docs, items = tables
    docs = [d for d in docs if len(d[1] or "") < 10_000]  # the SQL carries the list of words with each position
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    got = con.sql(f"select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ({op.SQL})").fetchall()
    assert sorted(map(tuple, got), key=repr) == plain(docs, items)


def test_empty_tables(spark, tables):
    docs, items = tables
    none = spark.createDataFrame([], DOCS)
    assert rows(op.contamination(none, spark.createDataFrame(items, ITEMS))) == []
    assert rows(op.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS))) == plain(docs, [])
    assert op.decontaminate(none, spark.createDataFrame(items, ITEMS)).collect() == []


def test_removal(spark, tables):
    docs, items = tables
    df = spark.createDataFrame([(*d, 1.5, "x") for d in docs], f"{DOCS}, n_hit double, gram_id string")
    bench = spark.createDataFrame(items, ITEMS)
    cleared = op.decontaminate(df, bench)
    assert cleared.schema == df.schema
    got = sorted(((r.doc_id, r.text) for r in cleared.collect()), key=repr)
    hits = {}
    for d in docs:
        if plain([d], items)[0][5]:
            hits[d] = None
    hits[docs[0]], hits[docs[1]], hits[docs[2]], hits[docs[3]], hits[docs[9]], hits[docs[10]] = "Before. after", "", "", "a b", "", ""
    want = [(d[0], "" if d[0] and d[0] >= 100 else hits.get(d, d[1])) for d in docs]
    assert got == sorted(want, key=repr)
    left = op.decontaminate(df, bench, remove="documents")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([d for d in docs if d not in hits], key=repr)
    with pytest.raises(ValueError):
        op.decontaminate(df, bench, remove="lines")


def test_plan_is_native_and_one_scan(spark, tables):
    docs, items = tables
    pairs = op.table(op.item_windows(spark.createDataFrame(items, ITEMS)))
    windows = op.table(pairs.select("len", "gram").distinct().withColumn("gram_id", op.F.monotonically_increasing_id()))
    plan = op.window_hits(spark.createDataFrame(docs, DOCS), windows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab .", max_size=30), max_size=4), st.lists(st.text("ab .", max_size=12), max_size=4))
def test_small_alphabet(spark, texts, items):
    docs, items = list(enumerate(texts)), list(enumerate(items))
    got = op.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), width=3)
    assert rows(got) == plain(docs, items, 3)
