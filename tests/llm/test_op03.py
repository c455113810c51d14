import re

import duckdb
import pytest

from seqprep.llm import op03_quality as q

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = [None, "", " \n\t", "a b c d e a b c d e", "x\nx\n\nx \nx", "é ü #1 a|b <p>", "one two three four five six seven eight nine ten eleven", "a\x0bb\x85c d", "a " * 5000, "same line here\nsame line here\r\nsame line here"]


def test_counts(spark):
    schema = "doc_id long, text string, lang string, source string, kept string, n_words int"
    rows = [(i, t, "en", None if i % 2 else "s", "", 0) for i, t in enumerate(TEXTS)] + [(None, "a b", None, None, "", 1)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.quality_rules(spark.createDataFrame(rows, schema)).collect()}
    assert got == {r[0]: brute(r[1]) if r[0] != 8 else (5000, 5000, 0, 0, 5000) for r in rows}
    assert q.quality_rules(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("value", [0, 1, 63, 64, 65, 127, 128, 1000, 99_999])
def test_buckets_are_tight(spark, value):
    from pyspark.sql import functions as F

    low = spark.range(1).select(q.floor_of(q.bucket(F.lit(value).cast("long"))).alias("x")).first().x
    assert low <= value and value - low <= value / 32


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    con.execute(f"create table answer as {q.SQL}")
    names = [c[0] for c in con.execute("select * from answer limit 0").description]
    rows = con.execute("select * from answer order by doc_id").fetchall()
    got = sorted(tuple(r[c] for c in names) for r in q.query(spark, SF).collect())
    assert got == rows
    assert 0.5 < sum(r[-1] for r in rows) / len(rows) < 1


def test_fences_follow_their_groups(spark):
    docs = spark.read.parquet(SF.replace("sf0.01", "sf0.1") + "/documents.parquet")
    groups = q.fences(measured(spark, docs)).toPandas()
    assert len(groups) == 80
    kinds = {m: groups[f"f_{m}"].nunique() for m in q.MEASURES}
    assert min(kinds.values()) > 1, kinds
    assert all(groups[f"f_{m}"].max() <= groups[f"f_{m}"].min() * q.CEILING / 100 + 1 for m in q.MEASURES)


def measured(spark, docs):
    names = ("doc_id", "lang", "source")
    rows = q.quality_rules(docs).drop("source", "lang")
    return docs.select(*names).join(rows, "doc_id").where("not base_failed")


def test_source_of_junk_is_rejected(spark):
    """Where 30 % of a source is symbols, the source doesn't raise its fence beyond them."""
    docs = spark.read.parquet(SF.replace("sf0.01", "sf0.1") + "/documents.parquet").select("doc_id", "text", "lang", "source")
    plain = [r.text for r in docs.where("lang = 'en' and length(text) between 300 and 2000").limit(120).collect()]
    plain = [plain[k % len(plain)] for k in range(120)]
    junk = lambda t: " ".join(w + "#$%&*" * (len(w) > 2) for w in t.split())
    made = spark.createDataFrame([(10_000_000 + k, junk(t) if k % 10 < 3 else t, "en", "junk") for k, t in enumerate(plain)], docs.schema)
    got = {r.doc_id: r for r in q.quality_rules(docs.union(made)).where("doc_id >= 10000000").collect()}
    rejected = [not r.kept for k, r in got.items() if (k - 10_000_000) % 10 < 3]
    assert min(r.symbols for k, r in got.items() if (k - 10_000_000) % 10 < 3) > 200
    assert all(rejected)
    clean = [r for k, r in got.items() if (k - 10_000_000) % 10 >= 3 and not r.base_failed]
    assert sum(r.rule != "symbols" or r.symbols > 150 for r in clean) == len(clean) and sum(r.kept for r in clean) > 0.8 * len(clean)


def test_very_long_text(spark):
    text = "\n".join(f"word{k} of line {k % 50_000} ends # here" for k in range(100_000))
    got = q.quality_rules(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert (got.n_words, got.n_symbols, got.n_dup_lines) == (700_000, 100_000, 0) and got.n_repeat_words > 0


def test_long_ranges_of_alike_sums():
    import numpy as np

    from seqprep.llm.textkernel import Text

    one = np.array([bin(i).count("1") % 2 for i in range(2048)], np.uint8) + 97
    other = np.uint8(97 + 98) - one
    for n in (511, 512, 1024, 2048):
        data = np.concatenate([one[:n], [32], other[:n], [32], one[:n]]).astype(np.uint8)
        h = Text(data, np.array([0, len(data)])).word_hashes()
        assert h[0] == h[2] != h[1], n
