import re
import string
from collections import Counter, defaultdict

import duckdb
import pytest

from seqprep.llm import op12_divergence as op

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(docs, least=3, top=200):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for (lang, source), counts in groups.items():
        kept = {t for t, n in df[lang].items() if n >= least}

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return lambda t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept))

        f = lambda a, b: (a - b) ** 2 // b
        mine = p(counts)
        pairs = [(s, sum(f(mine(t), p(c)(t)) for t in kept)) for (g, s), c in groups.items() if g == lang and s != source]
        all_ = p(sum((c for (g, _), c in groups.items() if g == lang), Counter()))
        marks = [(t, f(mine(t), all_(t))) for t in kept if counts[t] and mine(t) > all_(t)]
        for part, found, most in (("pair", pairs, None), ("term", marks, top)):
            ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.fixture(scope="module")
def docs():
    made = [(k, f"Alpha beta {'gamma ' * (k % 3)} x{'y' * (k % 5)} {'Élan élan' if k % 4 else ''}", "en" if k % 3 else None, ("a", "b", None, "B")[k % 4]) for k in range(60)]
    made += [(k, "alpha hot hot", "en", "hot") for k in range(300)]
    return [*made, (None, None, "en", "empty"), (None, "", "xx", "s1"), (7, "1234 !!", "xx", "s2"), (7, "only once", "yy", "s1"), (7, "other two", "yy", None), (8, "long " * 20_000 + "tail", "en", "a"), (9, "solo solo solo", "zz", "s")]


def test_equals_plain_version(spark, docs):
    df = spark.createDataFrame([(*d, 1, "v") for d in docs], SCHEMA + ", value long, term string")
    assert rows(op.source_divergence(df)) == plain(docs)
    assert rows(op.source_divergence(df, least=1, top=2)) == plain(docs, 1, 2)


def test_sql_agrees(docs):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", docs)
    assert sorted(map(tuple, con.sql(f"select lang, source, part, item, value, rank from ({op.SQL})").fetchall())) == plain(docs)


def test_no_rows(spark):
    assert rows(op.source_divergence(spark.createDataFrame([], SCHEMA))) == []


def test_marks_are_cut_before_the_shuffle(spark, docs):
    plan = op.source_divergence(spark.createDataFrame(docs, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, terms = 9_000_000_000_000_000, 9_000_000_000_000_001, 12_345
    got = spark.range(1).select(op.probability(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 1_000_000_000 * (n + 1) // (total + terms)
