"""Quality rules whose thresholds follow the data: per language and source, from mergeable quantile sketches.

Each text yields counts in one pass over its bytes. Four measures are put in integer buckets (exact below 64, then 32 buckets for each
doubling, so a quantile is off by 1/32 at most); bucket counts are the sketch: they merge by addition, in map-side combine, in any order with
one result, and a group's sketch has a few hundred rows however many documents it counts.

A group's quantile is taken over its documents. The quantile of a language, and of the corpus, is the median of its groups' quantiles, each counting with its documents, so it takes half of
the documents in bad sources to move it; the corpus's is at least what half of the documents with the measure have, as most documents have no symbols or repeats at all. A group's fence is shrunk by
counts, (n * own + SHRINK * language) / (n + SHRINK), and a language's likewise towards the corpus, so a small group follows its language; and it stays between the corpus's and CEILING
times that, else a source of junk would raise its own fence beyond its junk. A measure fails above its fence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkernel import _U, mix, texts

#: Measure: as an integer from the counts (per thousand characters, words and words; hundredths of a character); quantile of its fence, in percent of the documents.
MEASURES = {
    "symbols": ("1000 * n_symbols div word_chars", 95),
    "dup_lines": ("1000 * n_dup_lines div n_words", 99),
    "repeats": ("1000 * n_repeat_words div n_words", 98),
    "length": ("100 * word_chars div n_words", 99),
}
#: Weight of the level above a fence, in documents; highest fence, in hundredths of the corpus's.
SHRINK, CEILING = 50, 125
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _count(batches):
    for batch in batches:
        out = {c: np.zeros(batch.num_rows, np.int64) for c in _COUNTS}
        for a, b, t in texts(batch, "text", 1 << 19):
            n, d, o = b - a, t.data, t.offsets
            sums = np.zeros((3, len(d) + 1), np.int64)
            np.cumsum(t.word & ((d & 0xC0) != 0x80), out=sums[0, 1:])
            np.cumsum(_SYMBOL[d], out=sums[1, 1:])
            np.cumsum(t.word, out=sums[2, 1:])
            out["n_words"][a:b] = t.n_words
            out["word_chars"][a:b] = np.diff(sums[0][o])
            out["n_symbols"][a:b] = np.diff(sums[1][o])
            breaks = d == 10
            edge = np.zeros(len(d) + 1, bool)
            edge[o] = True
            edge[1:] |= breaks
            start = np.flatnonzero(edge[:-1])
            end = np.append(start[1:], len(d))
            end = end - (breaks[end - 1] if len(start) else 0)  # without the break
            has = sums[2][end] > sums[2][start]
            start, end = start[has], end[has]
            row = np.searchsorted(o, start, "right") - 1
            out["n_dup_lines"][a:b] = _again(t.hashes(start, end), row, n)[0]
            at, h = t.windows(5)
            _, twice = _again(h, t.row[at], n)
            cover = np.zeros(len(t.starts) + 6, np.int32)
            np.add.at(cover, at[twice], 1)
            np.add.at(cover, at[twice] + 5, -1)
            covered = np.cumsum(cover)[: len(t.starts)] > 0
            out["n_repeat_words"][a:b] = np.bincount(t.row[covered], minlength=n)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(out[c]) for c in _COUNTS)], names=["doc_id", "lang", "source", *_COUNTS])


def _again(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(by row: items equal to an earlier one of the row; flags of the items that occur twice or more in their row)."""
    key = mix(h ^ mix(row.astype(_U) + _U(1)))
    o = np.argsort(key)
    same = key[o][1:] == key[o][:-1]
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[1:] = same
    twice[o[1:]] |= same
    twice[o[:-1]] |= same
    return np.bincount(row[o[later]], minlength=n), twice


def bucket(x):
    """Integer bucket of a non-negative long: itself below 64, then 32 for each doubling."""
    bits = F.length(F.bin(x))
    shift = F.greatest(bits - 6, F.lit(0))
    return (shift * 32 + F.floor(x / F.pow(F.lit(2.0), shift))).cast("long")


def floor_of(b):
    """Smallest value in a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0))
    return ((b - shift * 32) * F.pow(F.lit(2.0), shift)).cast("long")


def quantiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, n, q, some, half) of the groups of counts and each measure: documents and their quantile, those where the measure is not zero and their median; from the groups' bucket counts."""
    from pyspark.sql import Window

    stacked = counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), bucket(F.col(m)).alias("b")) for m in MEASURES])).alias("x")).select(*keys, "x.m", "x.b")
    sketch = stacked.groupBy(*keys, "m", "b").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*keys, "m")
    ranked = sketch.withColumns({"n": F.sum("k").over(w), "none": F.sum(F.when(F.col("b") == 0, F.col("k")).otherwise(0)).over(w), "upto": F.sum("k").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))})
    quantile = F.create_map(*[x for m, (_, q) in MEASURES.items() for x in (F.lit(m), F.lit(q))])[F.col("m")]
    c, value = F.col, floor_of(F.col("b"))
    return ranked.groupBy(*keys, "m").agg(
        F.max("n").alias("n"), F.min(F.when(c("upto") * 100 >= c("n") * quantile, value)).alias("q"), F.max(c("n") - c("none")).alias("some"), F.min(F.when((c("b") > 0) & ((c("upto") - c("none")) * 2 >= c("n") - c("none")), value)).alias("half")
    )


def medians(groups: DataFrame, keys: list[str], n: str = "n", q: str = "q") -> DataFrame:
    """(keys, m, n, q): the sum of n and the median of q, each weighed by n, over the groups of quantiles()."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "m")  # a row for each group and measure
    ranked = groups.where(F.col(n) > 0).withColumn("total", F.sum(n).over(w)).withColumn("upto", F.sum(n).over(w.orderBy(q)))
    return ranked.groupBy(*keys, "m").agg(F.max("total").alias("n"), F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col(q))).alias("q"))


def fences(counts: DataFrame) -> DataFrame:
    """(lang, source, f_<measure>) for each group of counts(lang, source, measures)."""
    found = table(quantiles(counts, ["lang", "source"]))
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    half = medians(found, [], "some", "half").select(F.col("m").alias("h_m"), F.col("q").alias("h_q"))
    all_ = named(medians(found, []), "a_").join(half, F.col("a_m") == F.col("h_m"), "left").withColumn("least", F.greatest("a_q", F.coalesce("h_q", F.lit(0).cast("long"))))
    rows = found.join(named(medians(found, ["lang"]), "l_"), F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("m") == F.col("l_m"))).join(F.broadcast(all_), F.col("m") == F.col("a_m"))  # all_ has a row a measure
    shrunk = lambda n, q, above: F.floor((n * q + SHRINK * above) / (n + SHRINK))
    own = shrunk(F.col("n"), F.col("q"), shrunk(F.col("l_n"), F.col("l_q"), F.col("least")))
    fence = F.greatest(F.least(own, F.floor(F.col("least") * CEILING / 100)), F.col("least")).cast("long")
    return rows.withColumn("fence", fence).groupBy("lang", "source").agg(*[F.max(F.when(F.col("m") == k, F.col("fence"))).alias(f"f_{k}") for k in MEASURES])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the measures, rule, kept.

    base_failed: fewer than 10 words, or over a fifth of the words in 5-word windows that occur twice or more. rule: the first measure
    beyond its fence (null if none, or if base_failed). kept: not base_failed and no rule. Null texts count as empty, null languages and
    sources are groups of their own, ids may be null or repeat (each row is judged alone). Only documents that pass the base rules enter
    the sketches. No rows: no rows. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    counts = base.mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))
    counts = counts.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    counts = table(counts.withColumns({m: F.expr(f"if(n_words = 0, 0L, {e})") for m, (e, _) in MEASURES.items()}))
    groups = fences(counts.where("not base_failed")).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = counts.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    rule = F.when(F.col("base_failed"), None)
    for m in MEASURES:
        rule = rule.when(F.col(m) > F.col(f"f_{m}"), F.lit(m))
    return joined.withColumn("rule", rule).select("doc_id", *_COUNTS, "base_failed", *MEASURES, "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    bits = "length(bin({x}))"
    buck = lambda x: f"(greatest({bits.format(x=x)} - 6, 0) * 32 + ({x} >> greatest({bits.format(x=x)} - 6, 0)))"
    low = "((b - greatest(b // 32 - 1, 0) * 32) << greatest(b // 32 - 1, 0)::INT)"
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, {buck(m)} AS b, {q} AS percent FROM measured WHERE NOT base_failed" for m, (_, q) in MEASURES.items())

    def median(name: str, keys: str, n: str = "n", q: str = "q") -> str:
        k = f"{keys}, " if keys else ""
        return f"""{name}_r AS (SELECT {k}m, {q} AS q, sum({n}) OVER (PARTITION BY {k}m) AS n, sum({n}) OVER (PARTITION BY {k}m ORDER BY {q}) AS upto FROM own WHERE {n} > 0),
{name} AS (SELECT {k}m, max(n)::BIGINT AS n, min(q) FILTER (upto * 2 >= n) AS q FROM {name}_r GROUP BY {k}m)"""

    shrunk = lambda n, q, above: f"(({n} * {q} + {SHRINK} * {above}) // ({n} + {SHRINK}))"
    rules = ", ".join(f"max(fence) FILTER (m = '{m}') AS f_{m}" for m in MEASURES)
    case = " ".join(f"WHEN {m} > f_{m} THEN '{m}'" for m in MEASURES)
    measures = ", ".join(f"CASE WHEN n_words = 0 THEN 0 ELSE {e.replace(' div ', ' // ')} END AS {m}" for m, (e, _) in MEASURES.items())
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}+') AS words FROM d),
win AS (SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
grams AS (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS g FROM win),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{word}') GROUP BY rid),
counted AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
 FROM w LEFT JOIN covered USING (rid) LEFT JOIN dup USING (rid)),
measured AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {measures} FROM counted),
stacked AS ({stacked}),
own_r AS (SELECT *, sum(k) OVER g AS n, coalesce(sum(k) FILTER (b = 0) OVER g, 0) AS none, sum(k) OVER (g ORDER BY b) AS upto FROM (SELECT lang, source, m, b, percent, count(*) AS k FROM stacked GROUP BY ALL) WINDOW g AS (PARTITION BY lang, source, m)),
own AS (SELECT lang, source, m, max(n)::BIGINT AS n, min({low}) FILTER (upto * 100 >= n * percent) AS q, max(n - none)::BIGINT AS some_n, min({low}) FILTER (b > 0 AND (upto - none) * 2 >= n - none) AS half FROM own_r GROUP BY lang, source, m),
{median("bylang", "lang")}, {median("every", "")}, {median("halves", "", "some_n", "half")},
corpus AS (SELECT e.m, greatest(e.q, coalesce(h.q, 0)) AS least FROM every e LEFT JOIN halves h ON e.m = h.m),
chosen AS (SELECT o.lang, o.source, o.m, greatest(least({shrunk("o.n", "o.q", shrunk("l.n", "l.q", "a.least"))}, a.least * {CEILING} // 100), a.least) AS fence
 FROM own o JOIN corpus a ON o.m = a.m JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.m = l.m),
groups AS (SELECT lang, source, {rules} FROM chosen GROUP BY lang, source),
judged AS (SELECT x.*, CASE WHEN base_failed THEN NULL {case} END AS rule FROM measured x LEFT JOIN groups g ON x.lang IS NOT DISTINCT FROM g.lang AND x.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbols, dup_lines, repeats, length, rule, NOT base_failed AND rule IS NULL AS kept FROM judged
"""


SQL = _sql()
