"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, probed by every window of the documents. DataFrame functions only.

Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. An item's windows are its runs of WIDTH words; an item of fewer words is
one window of its own length. Documents are cut into words once; each position gives one hash for each length that the benchmark has, in the generated code of the
scan, and is looked up in the broadcast set; hits are verified on the words. What leaves the scan is one row a document and one a hit.

The set is broadcast in blocks of at most BLOCK windows, so the broadcast has a bound whatever the benchmark's size: a larger benchmark
means more passes over the documents, not a larger broadcast. Covered words are bits: a hit sets the bits of its words in one or two longs of 64 words, longs merge by bitwise
or in map-side combine, so a passage that a third of the documents hold makes no large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, old_ids, table, unique_ids

#: Words in a window.
WIDTH = 10
#: Windows in a broadcast (about 150 bytes each).
BLOCK = 200_000
_SEPARATOR = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # of the texts as they are
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The normalised words of a text, in order; none of a null text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), f"[{_SEPARATOR}]+"), "")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(item, len, gram) for each different window of each item; gram is its words with blanks between. A null id is written as empty."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col).cast("string")).alias("w"))
    items = items.select("item", "w", F.least(F.size("w"), F.lit(width)).alias("len")).where("len > 0")
    return items.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i")).select("item", "len", F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("gram")).distinct()


def _hash(at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get("w", at + k) for k in range(n)])


def window_hits(docs: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, i, len, gram_id) for docs(doc_id, text) with unique ids and windows(gram_id, len, gram), a written table: one row a
    document (i = -1, the only one with n_words) and one for each window (words i to i + len - 1) that is in windows."""
    sizes = {r[0]: r[1] for r in windows.groupBy("len").agg(F.count("*")).collect()}  # at most WIDTH rows
    lengths, blocks = sorted(sizes), max(1, -(-sum(sizes.values()) // block))
    split = F.split("gram", " ")
    keys = F.coalesce(*[F.when(F.col("len") == n, F.xxhash64(*[F.get(split, F.lit(k)) for k in range(n)])) for n in lengths], F.lit(0).cast("long"))
    keyed = windows.select("gram_id", "gram", F.col("len").cast("int").alias("g_len"), keys.alias("g_hash"))
    at = docs.select("doc_id", words(F.col("text")).alias("w"))
    at = at.select("doc_id", "w", F.explode_outer(F.sequence(F.lit(-1), F.size("w") - 1)).alias("i"))
    fits = lambda n: (F.col("i") >= 0) & (F.col("i") + n <= F.size("w"))
    probes = F.array(*[F.struct(F.lit(n).alias("len"), F.when(fits(n), _hash(F.col("i"), n)).alias("h")) for n in lengths or [WIDTH]])
    probe = at.select("doc_id", "w", "i", F.explode(probes).alias("x")).select("doc_id", "w", "i", "x.len", "x.h") if len(lengths) > 1 else at.select("doc_id", "w", "i", probes[0]["len"].alias("len"), probes[0]["h"].alias("h"))
    found = []
    for k in range(blocks):
        part = keyed.where(F.pmod(F.col("g_hash"), F.lit(blocks)) == k) if blocks > 1 else keyed
        same = (F.col("h") == F.col("g_hash")) & (F.col("len") == F.col("g_len")) & (F.array_join(F.slice("w", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("len")), " ") == F.col("gram"))
        hit = probe.join(F.broadcast(part), same, "left")  # at most about `block` rows
        first = (F.col("i") < 0) & (F.col("len") == (lengths or [WIDTH])[0])
        hit = hit.where(F.col("gram_id").isNotNull() | (first if k == 0 else F.lit(False)))
        found.append(hit.select("doc_id", F.when(F.col("i") < 0, F.size("w")).cast("long").alias("n_words"), "i", "len", "gram_id"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def covered(hits: DataFrame) -> DataFrame:
    """(doc_id, n_words, block, mask): bit k of mask is set if word 64 * block + k is in a hit window; block -1 has the count of words."""
    i, n = F.col("i"), F.col("len")
    ones, low = F.expr("shiftleft(1L, len) - 1"), F.pmod(i, F.lit(64)).cast("int")
    first = F.struct(F.shiftright(i, 6).alias("block"), F.call_function("shiftleft", ones, low).alias("mask"))
    second = F.struct((F.shiftright(i, 6) + 1).alias("block"), F.call_function("shiftrightunsigned", ones, 64 - low).alias("mask"))
    none = F.array(F.struct(F.lit(-1).alias("block"), F.lit(0).cast("long").alias("mask")))
    bits = hits.select("doc_id", "n_words", F.explode(F.when(i < 0, none).when(low + n > 64, F.array(first, second)).otherwise(F.array(first))).alias("x"))
    return bits.groupBy("doc_id", "x.block").agg(F.max("n_words").alias("n_words"), F.bit_or("x.mask").alias("mask"))


def _prepared(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, width: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(hits, the items of each gram), both written."""
    pairs = table(item_windows(benchmark, item_col, text_col, width))
    windows = table(pairs.select("len", "gram").distinct().withColumn("gram_id", F.monotonically_increasing_id()))
    items = windows.join(pairs, ["len", "gram"]).select("gram_id", "item")
    return table(window_hits(docs, windows, block)), items


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words in an occurrence of a window), n_items, items_sha256 (of the item ids, sorted as strings and comma-joined), contaminated.

    Null texts have no words. Ids may be null or repeat: each row is a document of its own; items of one id are one item, a null item id is an item
    written as an empty string. Items without words match nothing. Without items nothing is hit; no documents: no rows. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base, names = unique_ids(base, "doc_id", "text")
    hits, items = _prepared(base, benchmark, item_col, item_text_col, width, block)
    counts = covered(hits).groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.sum(F.bit_count("mask")).cast("long").alias("n_hit"))
    found = hits.where("i >= 0").select("doc_id", "gram_id").distinct().join(items, "gram_id").select("doc_id", "item").distinct()
    found = found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))
    out = counts.join(found, "doc_id", "left").select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    return old_ids(out, names, ["doc_id"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) with the hit words, each with the separators after it, cut from the texts (remove="spans"), or without the documents that have some (remove="documents").

    All columns stay; texts without hits (null ones too) stay as they are. Nulls, repeated ids and empty tables as in contamination().
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    rows, _ = boxed(docs)
    hits, _ = _prepared(rows.select("doc_id", "text"), benchmark, item_col, item_text_col, width, block)
    touched = hits.where("i >= 0").select(F.col("doc_id").alias("hit_id")).distinct()
    if remove == "documents":
        return rows.join(touched, F.col("doc_id") == F.col("hit_id"), "left_anti").select("row.*")
    all_blocks = hits.where("i < 0").join(touched, F.col("doc_id") == F.col("hit_id"), "left_semi").select("doc_id", F.explode(F.sequence(F.lit(0), F.shiftright(F.col("n_words"), 6).cast("int"))).alias("block"), F.lit(0).cast("long").alias("mask"))
    blocks = covered(hits.where("i >= 0")).select("doc_id", F.col("block").cast("int").alias("block"), "mask").union(all_blocks)
    masks = blocks.groupBy("doc_id", "block").agg(F.bit_or("mask").alias("mask")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "mask"))).alias("masks"))  # a long for 64 words of the text
    joined = rows.join(masks.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id") == F.col("hit_id"), "left")
    pieces = F.regexp_extract_all("text", F.lit(f"[^{_SEPARATOR}]+[{_SEPARATOR}]*"), 0)
    clear = F.filter(pieces, lambda p, k: F.call_function("getbit", F.get("masks", F.shiftright(k, 6))["mask"], F.pmod(k, F.lit(64)).cast("int")) == 0)
    text = F.when(F.col("hit_id").isNull(), F.col("text")).otherwise(F.concat(F.regexp_extract("text", f"^[{_SEPARATOR}]*", 0), F.array_join(clear, "")))
    return joined.select(*[text.cast(f.dataType).alias(f.name) if f.name == "text" else F.col("row")[f.name].alias(f.name) for f in docs.schema])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    cut = lambda text: rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {cut("text")} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {cut("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item, w, least(len(w), {WIDTH}) AS n, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM g),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (SELECT rid, i, a.n, g.item FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places, lens WHERE i + n - 1 <= len(w)) a JOIN g ON a.gram = g.gram AND a.n = g.n),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""


SQL = _sql()
