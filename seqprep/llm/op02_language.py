"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on the language of a text are multiplied: its likelihood under byte-trigram models of each language (tempered, as
neighbouring trigrams are not independent), the declared markup language, the address suffix with the path's language segment, and the
host's prior. Declared languages and suffixes count through their grouped confusion with the text's own best guess over
all rows, so a label that is often wrong weighs little. Host priors are smoothed hierarchically: all rows, then the domain, then
the host, each drawn towards the one above by STRENGTH rows. Trigram counts are hashed to BUCKETS cells for each declared language and summed
over all rows. Every language that LEAST rows declare has its own model, whatever its share of the rows; those declared by fewer share one, OTHER. Language codes have two or three letters,
so there are 18,252 models at most, of 32 KB each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, chosen, table
from .op10_extraction import main_text
from .textkernel import _U, flat, pieces, trimmed

BUCKETS = 1 << 13
#: Rows that declare a language, for it to have a model.
LEAST = 3
#: The language of the declared languages with fewer rows, longer than any label.
OTHER = "other"
STRENGTH = 20.0
#: Trigrams that count in full; the log-likelihood of a longer text is scaled down to as many.
TRIGRAMS = 60
#: Posterior that a language needs.
CONFIDENT = 0.5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _extract(batches):
    for b in batches:
        text = pa.array([main_text(x) for x in b.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([text, *b.columns[1:]], names=b.schema.names)


def _trigrams(batch: pa.RecordBatch):
    """(first row, last row, row of each trigram, its cell): byte trigrams with two letters or more of the lower-case text."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), "")))
    for a, b in pieces(offsets, 1 << 19):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(d) < 3:
            continue
        row = np.repeat(np.arange(b - a), np.diff(o))
        letter = _LETTER[d]
        x = np.where(letter, d, 32).astype(_U)
        ok = (row[2:] == row[:-2]) & (letter[2:].astype(np.int8) + letter[1:-1] + letter[:-2] >= 2)
        cell = (((x[:-2] << _U(16)) | (x[1:-1] << _U(8)) | x[2:]) * _U(0x9E3779B97F4A7C15)) >> _U(64 - 13)
        yield a, b, row[2:][ok], cell[ok].astype(np.int64)


def _counts(languages: list[str]):
    def run(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        index = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            of = np.array([-1 if x is None else index.get(x, index.get(OTHER, -1)) for x in batch.column("declared").to_pylist()])
            for a, b, row, cell in _trigrams(batch):
                k = of[a:b][row]
                total += np.bincount(k[k >= 0] * BUCKETS + cell[k >= 0], minlength=total.size).reshape(total.shape)
        lang, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[lang, cell])], names=["k", "cell", "n"])

    return run


def _likelihoods(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            ll = np.zeros((batch.num_rows, len(model)))
            for a, b, row, cell in _trigrams(batch):
                n[a:b] = np.bincount(row, minlength=b - a)
                for k, logs in enumerate(model):
                    ll[a:b, k] = np.bincount(row, logs[cell], minlength=b - a)
            ll *= (np.minimum(n, TRIGRAMS) / np.maximum(n, 1))[:, None]
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(model))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(ll.reshape(-1)))], names=[*names, "n", "ll"])

    return run


def _tally(rows: DataFrame, keys: list[str], size: int, above=None) -> DataFrame:
    """keys and p: shares of the best guesses in each group, drawn towards above (or even shares) by STRENGTH rows."""
    counts = rows.groupBy(*keys).agg(*[F.sum(F.when(F.col("guess") == k, 1.0).otherwise(0.0)).alias(f"n{k}") for k in range(size)], *([F.first(above).alias("_above")] if above else []))
    total = sum((F.col(f"n{k}") for k in range(1, size)), F.col("n0")) + STRENGTH
    up = (lambda k: F.col("_above")[k]) if above else (lambda k: F.lit(1.0 / size))
    return counts.select(*keys, F.array(*[(F.col(f"n{k}") + STRENGTH * up(k)) / total for k in range(size)]).alias("p"))


def language_id(rows: DataFrame, id_col: str, text: str, declared: str | None = None, url: str | None = None, host: str | None = None, html: bool = False) -> DataFrame:
    """One row per row: id, host, declared, n_trigrams, text_lang, lang, prob, kept.

    text, declared, url and host are column names; html: text and markup language are read from pages; declared labels also train
    the trigram models. Null ids, texts, urls and labels are allowed: what is missing is no evidence, and its group is null. kept: the text has trigrams, its language has
    a posterior of CONFIDENT or more, and the declared language, or OTHER for one of fewer than LEAST rows, isn't excluded by the text (a posterior under 1 - 0.999 of being right).
    Texts like those of the languages of fewer rows: lang and text_lang are OTHER. Without any declared language: lang null, not kept. Repeated ids: each row is judged alone. No rows: no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    given = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    label = F.regexp_extract(given(text), r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1) if html else F.regexp_extract(given(declared), r"^\s*([A-Za-z]{2,3})\b", 1)
    address = F.lower(F.regexp_extract(given(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)) if url else given(host)
    path = F.lower(F.regexp_extract(given(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    some = lambda c: F.when(c == "", None).otherwise(c)
    base = rows.select(F.col(id_col).cast("long").alias("id"), given(text).alias("text"), some(F.lower(label)).alias("declared"), some(address).alias("host"), path.alias("path"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    if html:  # extracted once
        base = table(base.select("text", "id", "declared", "host", "path").mapInArrow(trimmed(_extract), "text string, id long, declared string, host string, path string"))
    base = base.withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain)).withColumn("suffix", F.concat_ws("/", F.regexp_extract("host", r"\.([^.]+)$", 1), "path"))
    sizes = base.groupBy("declared").agg(F.count("*").alias("n"))
    languages = [r[0] for r in sizes.where(F.col("declared").isNotNull() & (F.col("n") >= LEAST)).orderBy("declared").collect()]  # codes of two or three letters
    frequent = list(languages)
    if sizes.where(F.col("declared").isNotNull() & ~F.col("declared").isin(frequent)).limit(1).count():
        languages.append(OTHER)
    out = lambda df: df.select("id", "host", "declared", "n_trigrams", "text_lang", "lang", "prob", "kept")
    if not languages:
        none = F.lit(None).cast("string")
        return out(base.select("id", "host", "declared", F.lit(0).cast("long").alias("n_trigrams"), none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("prob"), F.lit(False).alias("kept")))
    size = len(languages)
    model = np.zeros((size, BUCKETS))
    for r in base.select("text", "declared").mapInArrow(trimmed(_counts(languages)), "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):  # a bounded table
        model[r.k, r.cell] = r.n
    even = model.sum(axis=0) / max(model.sum(), 1)
    model = np.log((model + 50 * even + 1e-3) / (model.sum(axis=1, keepdims=True) + 50 + 1e-3 * BUCKETS)).astype(np.float32)
    shared = spark.sparkContext.broadcast(model)
    scored = table(base.select("id", "declared", "host", "domain", "suffix", "text").mapInArrow(trimmed(_likelihoods(shared)), "id long, declared string, host string, domain string, suffix string, n long, ll array<double>"))
    guess = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    scored = scored.withColumn("guess", F.when(F.col("n") > 0, guess))
    all_ = np.array(_tally(scored.where("guess is not null"), [], size).first()[0]) if scored.where("guess is not null").limit(1).count() else np.full(size, 1 / size)
    prior = F.array(*[F.lit(float(x)) for x in all_])
    by_domain = _tally(scored.withColumn("_all", prior), ["domain"], size, "_all").select(F.col("domain").alias("d_domain"), F.col("p").alias("d_p"))
    hosts = scored.groupBy("host", "domain", "guess").agg(F.count("*").alias("m"))  # hot hosts become a few rows
    wide = hosts.groupBy("host", "domain").agg(*[F.sum(F.when(F.col("guess") == k, F.col("m")).otherwise(0)).alias(f"n{k}") for k in range(size)])
    wide = wide.join(by_domain, F.col("domain").eqNullSafe(F.col("d_domain")))
    count = sum((F.col(f"n{k}") for k in range(1, size)), F.col("n0")) + F.lit(STRENGTH)
    by_host = wide.select(F.col("host").alias("h_host"), F.array(*[(F.col(f"n{k}") + STRENGTH * F.col("d_p")[k]) / count for k in range(size)]).alias("h_p"))
    # likelihood of a label or suffix in each language: its share there over its share in all rows
    ratio = lambda p: F.transform(p, lambda x, k: F.log(x / prior[k]))
    by_label = _tally(scored.withColumn("_all", prior), ["declared"], size, "_all").select(F.col("declared").alias("l_declared"), ratio(F.col("p")).alias("l_r"))
    by_suffix = _tally(scored.withColumn("_all", prior), ["suffix"], size, "_all").select(F.col("suffix").alias("s_suffix"), ratio(F.col("p")).alias("s_r"))
    # by_label has a row for each code, 18,252 at most
    joined = (
        scored.join(by_host, F.col("host").eqNullSafe(F.col("h_host")), "left")
        .join(F.broadcast(by_label), F.col("declared").eqNullSafe(F.col("l_declared")), "left")
        .join(by_suffix, F.col("suffix").eqNullSafe(F.col("s_suffix")), "left")
    )
    nothing = F.array(*[F.lit(0.0)] * size)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    label_r = F.when(F.col("declared").isNotNull(), F.col("l_r")).otherwise(nothing)
    logs = add(add(F.col("ll"), F.transform(F.coalesce("h_p", prior), lambda x: F.log(x))), add(label_r, F.coalesce("s_r", nothing)))
    names = F.array(*[F.lit(x) for x in languages])
    judged = joined.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    judged = judged.withColumn("mass", F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    own = F.array_position(names, F.when(F.col("declared").isin(frequent), F.col("declared")).when(F.col("declared").isNotNull(), F.lit(OTHER))).cast("int")
    stands = F.when(own > 0, F.exp(F.get("logs", own - 1) - F.col("top")) / F.col("mass") >= 0.001).otherwise(F.lit(True))
    return out(
        judged.withColumn("prob", 1 / F.col("mass"))
        .withColumn("lang", names[F.array_position("logs", F.col("top")).cast("int") - 1])
        .withColumn("text_lang", F.get(names, F.col("guess")))
        .withColumn("n_trigrams", F.col("n"))
        .withColumn("kept", F.coalesce((F.col("n") > 0) & (F.col("prob") >= CONFIDENT) & stands, F.lit(False)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return language_id(pages, "page_id", "html", url="url", html=True).withColumnRenamed("id", "page_id")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, with their columns as they are: lang as the declared label, source as the host."""
    rows, _ = boxed(docs, "lang", "source")
    return chosen(rows, language_id(rows, "doc_id", "text", declared="lang", host="source").where("kept").select("id"))
