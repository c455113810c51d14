"""N-gram Jaccard join: near-duplicate documents by MinHash banding, verified on full sets of word n-grams.

Documents with equal n-gram sets form one class; only the smallest id of each goes on, and of those only sets that are large enough to link with a different one. BANDS bands of ROWS minimum
hashes miss a pair at the threshold with probability (1 - 0.8**6)**34 = 3e-5, and fewer still as members of one chain of bands
are all compared; pairs at 0.5 meet with probability 0.4, at 0.3 with 0.02. Bands are dealt by hash; each bucket is a star to its smallest id (a grouped minimum and a join, no pairs), and the
components of the stars are the blocks of verification: each class's n-gram set is sent once for each block pair it is in,
never once for each band. A component with many sets or n-grams is cut by size, as sets whose sizes differ by more than the threshold can't link, and into parts of PART_SETS sets and PART_GRAMS n-grams; each
pair of parts that can link is a task of bounded size, so that a hot group is spread over the cluster. A task compares all of its classes by matrix products over shared n-grams,
and returns link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, old_ids, partitions, table, unique_ids
from .textkernel import mix, signed, texts, trimmed

_U = np.uint64
BANDS, ROWS = 34, 6
#: N-grams and sets in one part of a component.
PART_GRAMS, PART_SETS = 200_000, 128
#: Columns of a matrix product.
_COLUMNS = 4096


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each row of a batch."""
    for a, b, t in texts(batch, "text"):
        row, h = t.shingles(width)
        o = np.argsort(h)
        row, h = row[o], h[o]
        o = np.argsort(row, kind="stable")
        row, h = row[o], h[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        row, h = row[new], h[new]
        at = np.searchsorted(row, np.arange(b - a + 1))
        for k in range(b - a):
            yield a + k, h[at[k] : at[k + 1]]


def _signatures(width: int, bands: int, rows: int):
    rng = np.random.default_rng(20240601)
    k = bands * rows
    mult = (rng.integers(0, 1 << 31, (2, k, 1), dtype=np.int64).astype(np.uint32) * np.uint32(2)) + np.uint32(1)
    fold = (rng.integers(1, 1 << 63, rows, dtype=np.int64).astype(_U) * _U(2) + _U(1))[None, :]
    number = np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            key, size, made, filled = np.zeros((n, 2), np.int64), np.zeros(n, np.int32), np.zeros((n, bands), _U), np.zeros(n, bool)
            for row, h in _sets(batch, width):
                if not len(h):
                    continue
                filled[row] = True
                size[row] = len(h)
                key[row] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                least, high = np.full(k, np.uint32((1 << 32) - 1)), (h >> _U(32)).astype(np.uint32)
                for at in range(0, len(h), 1024):
                    x = high[at : at + 1024] * mult[0]
                    x ^= x >> np.uint32(15)
                    x *= mult[1]
                    least = np.minimum(least, x.min(axis=1))
                made[row] = mix((least.astype(_U).reshape(bands, rows) * fold).sum(axis=1, dtype=_U) + number)
            keep = pa.array(filled)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(signed(made.reshape(-1))))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(size), lists], names=["doc_id", "k1", "k2", "size", "bands"])
            yield out.filter(keep)

    return run


def _gram_sets(width: int):
    def run(batches):
        for batch in batches:
            sets = [h for _, h in _sets(batch, width)]
            ends = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int32)
            grams = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(grams))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "grams"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of the incidence matrix over the elements in two sets or more, in column blocks."""
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    who, column = who[shared], new[column[shared]]
    o = np.argsort(column, kind="stable")
    who, column = who[o], column[o]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(new[-1]) + 1 if len(new) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        x = np.zeros((len(sets), _COLUMNS), np.float32)
        x[who[a:b], column[a:b] - at] = 1
        total += x @ x.T
    return total.astype(np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the edges (a, b) join, n - 1 at most."""
    up = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = x, y
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        while up[j] != j:
            up[j] = up[up[j]]
            j = up[j]
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append((x, y))
    return out


_FOUND = "doc_id long, other long, n_links long"


def _verify(threshold: float):
    """Rows sorted by block; a block is (component, part, other part), its sides the two parts: (doc_id, null, links found in it) and (doc_id, other, null) for a spanning forest."""
    num, den = int(round(threshold * 1000)), 1000

    def solve(rows, cross):
        ids = np.array([r[0] for r in rows], np.int64)
        sets, copies, side = [r[1] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows])
        both = overlaps(sets)
        size = np.array([len(s) for s in sets], np.int64)
        linked = both * (num + den) >= num * (size[:, None] + size[None, :])  # J >= t, J = both / (sum - both)
        np.fill_diagonal(linked, False)
        if cross:
            linked &= side[:, None] != side[None, :]  # within a part: in the block of that part with itself
        links = linked @ copies
        a, b = np.nonzero(np.triu(linked))
        hit = np.flatnonzero(links)
        tree = forest(len(ids), a, b)
        return ids[hit], links[hit], ids[[x for x, _ in tree]], ids[[y for _, y in tree]]

    def out(found):
        hit, links, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([hit, a])), pa.concat_arrays([none(len(hit)), pa.array(b)]), pa.concat_arrays([pa.array(links), none(len(a))])], names=["doc_id", "other", "n_links"])

    def run(batches):
        held, last, found = [], None, []
        for batch in batches:
            block = list(zip(*(batch.column(c).to_pylist() for c in ("component", "p", "q")), strict=True))
            ids, copies, side = (batch.column(c).to_pylist() for c in ("doc_id", "copies", "side"))
            lists = batch.column("grams")
            for k in range(batch.num_rows):
                if block[k] != last:
                    if len(held) > 1:
                        found.append(solve(held, last[1] != last[2]))
                    if len(found) > 500:
                        yield out(found)
                        found = []
                    held, last = [], block[k]
                held.append((ids[k], np.array(lists[k].values.to_numpy()).view(_U), copies[k], side[k]))
        if len(held) > 1:
            found.append(solve(held, last[1] != last[2]))
        if found:
            yield out(found)

    return run


def block_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """doc_id, copies and the blocks (component, p, q) of each row of members(doc_id, component, size, copies), with the row's side in the block.

    p and q are numbers of a size class and a part in it. Components within the bounds of a part are one block.
    """
    size = members.groupBy("component").agg(_parts().alias("whole"))
    base = float(np.log(1.0001 / threshold))  # sets that can link are in one size class or in neighbours
    cell = F.when(F.col("whole") > 1, F.floor(F.log("size") / base)).otherwise(0).cast("long")
    celled = members.join(size, "component").withColumn("cell", cell)
    w = Window.partitionBy("component").orderBy("cell").rangeBetween(1, 1)  # a component has few size classes
    cells = celled.groupBy("component", "cell").agg(_parts().alias("parts")).withColumn("above", F.coalesce(F.max("parts").over(w), F.lit(0)))
    cells = cells.withColumn("below", F.coalesce(F.max("parts").over(Window.partitionBy("component").orderBy("cell").rangeBetween(-1, -1)), F.lit(0)))
    at = lambda cell, part: F.shiftleft(cell, 32) + part
    here = at(F.col("cell"), F.col("part"))
    pair = lambda p, q, side: F.struct(p.alias("p"), q.alias("q"), side.cast("int").alias("side"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(upto("parts"), lambda x: pair(at(F.col("cell"), F.least("part", x)), at(F.col("cell"), F.greatest("part", x)), (F.col("part") > x)))
    above = F.transform(upto("above"), lambda x: pair(here, at(F.col("cell") + 1, x), F.lit(0)))
    below = F.transform(upto("below"), lambda x: pair(at(F.col("cell") - 1, x), here, F.lit(1)))
    dealt = celled.join(cells, ["component", "cell"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    return dealt.select("doc_id", "copies", "component", F.explode(F.concat(own, above, below)).alias("x")).select("doc_id", "copies", "component", "x.p", "x.q", "x.side")


def _parts():
    return F.greatest(F.ceil(F.sum("size") / PART_GRAMS), F.ceil(F.count("*") / PART_SETS)).cast("int")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links, kept.

    copy_id: smallest id with the same set of word n-grams. n_links: other documents at a Jaccard similarity of threshold or more, copies
    included. class_id: smallest id that links reach, itself included; kept: doc_id = class_id. A text of 1 to width - 1 words has
    one n-gram, all of its words; null texts and texts without words link with nothing. Null or repeated ids: each row is a document of its
    own, in the order (id, nulls last, text), and of repeated rows the first is kept. No rows: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    base, names = unique_ids(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    signed_rows = table(base.mapInArrow(trimmed(_signatures(width, bands, rows)), "doc_id long, k1 long, k2 long, size int, bands array<long>"))
    classes = table(signed_rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies")))
    firsts = signed_rows.join(classes, (signed_rows.doc_id == classes.copy_id) & (signed_rows.k1 == classes.k1) & (signed_rows.k2 == classes.k2)).select("doc_id", "size", "copies", "bands")
    least = int(np.ceil(threshold / (1 - threshold) - 1e-9)) if threshold < 1 else 1 << 31  # a smaller set and a different one have a union too large to link
    buckets = firsts.where(F.col("size") >= least).select("doc_id", F.posexplode("bands").alias("band", "h"))
    stars = buckets.groupBy("band", "h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "h", "least")
    blocks = table(components(buckets.join(stars, ["band", "h"]).where("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))))
    members = table(firsts.drop("bands").join(blocks.withColumnRenamed("id", "doc_id"), "doc_id"))
    pairs = block_pairs(members, threshold)
    sets = base.join(members.select("doc_id"), "doc_id", "left_semi").mapInArrow(trimmed(_gram_sets(width)), "doc_id long, grams array<long>")
    found = table(sets.join(pairs, "doc_id").repartition(n, "component", "p", "q").sortWithinPartitions("component", "p", "q").mapInArrow(trimmed(_verify(threshold)), _FOUND))
    links = found.where("other is null").groupBy("doc_id").agg(F.sum("n_links").alias("links")).withColumnRenamed("doc_id", "l_id")
    linked = components(found.where("other is not null").select(F.col("doc_id").alias("u"), F.col("other").alias("v"))).withColumnRenamed("id", "c_id")
    classed = classes.join(links, F.col("copy_id") == F.col("l_id"), "left").join(linked, F.col("copy_id") == F.col("c_id"), "left")
    classed = classed.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "copy_id", F.coalesce("component", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = signed_rows.select("doc_id", "k1", "k2").join(classed, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))).select(F.col("doc_id").alias("s_id"), "copy_id", "class_id", "n_links")
    result = base.select("doc_id").join(known, F.col("doc_id") == F.col("s_id"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return old_ids(result.withColumn("kept", F.col("doc_id") == F.col("class_id")), names, ["doc_id", "class_id", "copy_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wide AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM wide UNION SELECT doc_id, concat(len(w), '# ', array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM grams GROUP BY doc_id),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS copy_id FROM sizes),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 10 * n_both >= 8 * (x.n + y.n - n_both)),
reach(u, v) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS class_id FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT w.doc_id, class_id, coalesce(copy_id, w.doc_id) AS copy_id, coalesce(n, 0)::BIGINT AS n_links, w.doc_id = class_id AS kept
FROM w JOIN least l ON w.doc_id = l.u LEFT JOIN degree d ON w.doc_id = d.u LEFT JOIN copies c ON w.doc_id = c.doc_id
"""
