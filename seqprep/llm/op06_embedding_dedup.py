"""Near-duplicate embeddings by spherical-cap filters of random product codes.

A code has two blocks of random Gaussian codewords, one for each half of a vector; a filter direction is a pair of codewords, and a unit
vector's score for it is standard normal. Each vector is list-decoded to all filters whose score exceeds the cap's threshold: with the
second block sorted, the partners of each first codeword are a prefix. Vectors join on (label, code, filter); members of a bucket are verified by cosine in double
precision. The number of codewords and the threshold follow from the number of vectors of a label, so that a vector meets about
FILTERS filters of each of CODES codes and an unclustered bucket about BUCKET vectors at every size. Equal vectors are one class. A vector is sent once for
each block of up to WIDTH neighbouring filters with all those that it exceeds there; buckets with over PART vectors are blocks of their own, cut into parts,
a task for each pair of parts. A task returns link counts and a spanning forest, not pairs, and counts a pair only in the first block where its two
vectors share a filter: the filters before a block travel as packed differences.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, old_ids, partitions, table, unique_ids
from .op01_ngram_join import forest

CODES, FILTERS, BUCKET = 8, 5, 32
#: Vectors in one part of a bucket.
PART = 512
#: Filters of a block: neighbours that share a first codeword, at most 256.
WIDTH = 32


def matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None for null, zero, empty ones and those with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for x in column:
        if not x.is_valid or x.values is None or x.values.null_count or not len(x.values):
            out.append(None)
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(float)
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # neither overflow nor underflow in the squares
    return v / np.sqrt(v @ v)


def plan(n: int) -> tuple[int, float]:
    """(codewords of a block, threshold) for n vectors: about FILTERS filters a vector and BUCKET vectors a filter."""
    words = max(8, int(np.ceil(np.sqrt(FILTERS * max(n, 1) / BUCKET))))
    return words, NormalDist().inv_cdf(1 - min(FILTERS / words**2, 0.4))


def codewords(dim: int, words: int, code: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20240607, dim, words, code])
    half = dim // 2
    return rng.standard_normal((half, words)), rng.standard_normal((dim - half, words))


def decode(x: np.ndarray, words: int, threshold: float, code: int, blocks=None) -> list[np.ndarray]:
    """For each unit vector the numbers of the filters that it exceeds, ascending."""
    first, second = blocks or codewords(x.shape[1], words, code)
    a, b = x[:, : len(first)] @ first, x[:, len(first) :] @ second
    order = np.argsort(-b, axis=1)
    out = []
    for k in range(len(x)):
        falling = b[k][order[k]]
        many = np.searchsorted(-falling, a[k] - threshold, "right")  # b >= threshold - a
        i = np.repeat(np.arange(words), many)
        j = order[k][np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)]
        out.append(np.sort((code * words + i) * words + j))
    return out


def _key_rows(batches):
    for b in batches:
        rows = [k for k, v in enumerate(matrix(b.column("embedding"))) if v is not None]
        vectors = matrix(b.column("embedding"))
        keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(vectors[k].tobytes()), np.int64) for k in rows], np.int64).reshape(-1, 2)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("label").take(take), pa.array([len(vectors[k]) for k in rows], pa.int32()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], names=["vec_id", "label", "dim", "k1", "k2"])


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(non-negative integers in seven bits a byte, the place where each one's bytes end)."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        has = size > k
        out[(ends - size)[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), ends


def unpacked(data: bytes) -> np.ndarray:
    """The ascending numbers whose differences packed() wrote."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(x < 128)[:-1] + 1])
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return np.cumsum(np.add.reduceat((x & 127).astype(np.int64) << (7 * place), starts))


def differences(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Differences within each of the ascending lists that flat holds one after another; the first of a list is itself."""
    d = np.diff(flat, prepend=0)
    firsts = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
    d[firsts] = flat[firsts]
    return d


def _filters(batches):
    """Rows with n, the number of vectors of their label and length: the codewords of a block, the vector's filters, ascending, and the vector as it came."""
    made: dict[tuple, tuple] = {}
    for b in batches:
        n, vectors = b.column("n").to_pylist(), matrix(b.column("embedding"))
        groups: dict[tuple, list[int]] = {}
        for k, v in enumerate(vectors):
            groups.setdefault((len(v), *plan(n[k])), []).append(k)
        for (dim, words, threshold), rows in groups.items():
            x = np.array([unit(vectors[k]) for k in rows])
            lists = []
            for code in range(CODES):
                key = (dim, words, code)
                if key not in made:
                    if len(made) > 64:
                        made.clear()
                    made[key] = codewords(*key)
                lists.append(decode(x, words, threshold, code, made[key]))
            whole = [np.concatenate(f) for f in zip(*lists, strict=True)]
            ends = np.cumsum([0, *map(len, whole)]).astype(np.int32)
            take = pa.array(rows, pa.int64())
            filters = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(whole).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("vec_id", "label", "dim", "copies")), pa.array(np.full(len(rows), words, np.int32)), filters, b.column("embedding").take(take)], names=["vec_id", "label", "dim", "copies", "words", "filters", "embedding"])


_SENT = ["label", "dim", "block", "p", "q", "vec_id", "copies", "part", "here", "before", "embedding"]


def _send(batches):
    """Each vector once for each of its blocks, with its filters in it and, packed, those before it.

    A block is WIDTH neighbouring filters of one first codeword. Filters with too many vectors (hot, with their parts) are blocks of their own, one row
    for each pair of parts; for these, the other filters of the block around them count as before.
    """
    for b in batches:
        lists, words = b.column("filters"), b.column("words").to_numpy().astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        owner = np.repeat(np.arange(b.num_rows), ends - begins)
        if not len(flat):
            continue
        w = words[owner]
        row, j = flat // w, flat % w
        block = row * -(-w // WIDTH) + j // WIDTH
        firsts = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(block) != 0)))
        data, byte_ends = packed(differences(flat, ends))
        byte_begins = np.concatenate([[0], byte_ends[:-1]])
        hot = np.zeros(len(flat), bool)
        sent = {c: [] for c in _SENT[2:5] + _SENT[7:10]}
        to: list[int] = []

        def add(k, block, p, q, part, here, before):
            to.append(k)
            for c, v in zip(sent, (block, p, q, part, here, before), strict=True):
                sent[c].append(v)

        def out():
            take = pa.array(to, pa.int64())
            kinds = {"block": pa.int64(), "p": pa.int32(), "q": pa.int32(), "part": pa.int32(), "here": pa.binary(), "before": pa.binary()}
            made = {c: pa.array(v, kinds[c]) for c, v in sent.items()}
            rows = pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c).take(take) for c in _SENT], names=_SENT)
            for v in (to, *sent.values()):
                v.clear()
            return rows

        ids = b.column("vec_id").to_numpy().astype(np.uint64)
        split = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
        for k, (some, parts) in enumerate(zip(b.column("hot").to_pylist(), b.column("parts").to_pylist(), strict=True)):
            if not some:
                continue
            own = flat[begins[k] : ends[k]]
            hot[begins[k] : ends[k]] = mine = np.isin(own, some)
            for f, n in zip(some, parts, strict=True):
                at = begins[k] + np.searchsorted(own, f)
                same = block[begins[k] : ends[k]] == block[at]
                before = own[(~same & (own < f)) | (same & (~mine | (own < f)))]
                code, part = packed(differences(before, np.array([len(before)])))[0], int(split[k] % n)
                for other in range(n):
                    add(k, f, min(part, other), max(part, other), part, b"\0", code)
                    if len(to) >= 4096:
                        yield out()
        cold = np.flatnonzero(~hot)
        starts = np.flatnonzero(np.append(True, (np.diff(owner[cold]) != 0) | (np.diff(block[cold]) != 0))) if len(cold) else np.zeros(0, np.int64)
        first = firsts[np.searchsorted(firsts, cold[starts], "right") - 1]
        here = (j[cold] % WIDTH).astype(np.uint8).tobytes()
        bounds = np.append(starts, len(cold)).tolist()
        for m, (k, at) in enumerate(zip(owner[cold[starts]].tolist(), first.tolist(), strict=True)):
            add(k, int(block[at]), -1, -1, 0, here[bounds[m] : bounds[m + 1]], data[byte_begins[begins[k]] : byte_begins[at]])
            if len(to) >= 4096:
                yield out()
        if to:
            yield out()


def shared(lists: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the packed lists a[k] and b[k] have a number in common."""
    found = np.zeros(len(a), bool)
    some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    values = [unpacked(lists[k]) for k in some]
    names, column, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    place = np.cumsum(count > 1) - 1  # a number of one list alone is never in common
    row, column = row[count[column] > 1], place[column[count[column] > 1]]
    for low in range(0, int(column.max()) + 1 if len(column) else 0, 512):
        bits = np.zeros((len(values), 512), bool)
        at = (column >= low) & (column < low + 512)
        bits[row[at], column[at] - low] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(a), 1 << 16):
            found[k : k + (1 << 16)] |= (bits[a[k : k + (1 << 16)]] & bits[b[k : k + (1 << 16)]]).any(axis=1)
    return found


def _verify(cosine: float):
    def solve(ids, copies, part, here, before, x):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        n = len(ids)
        has = np.zeros((n, WIDTH), np.float32)
        has[np.repeat(np.arange(n), [len(h) for h in here]), np.frombuffer(b"".join(here), np.uint8)] = 1
        pairs, step = [], max(16, (1 << 22) // n)
        for low in range(0, n, step):
            linked = x[low : low + step] @ x[low:].T >= cosine
            linked &= np.arange(low, n)[None, :] > np.arange(low, min(low + step, n))[:, None]
            if not linked.any():
                continue
            linked &= has[low : low + step] @ has[low:].T > 0
            a, b = np.nonzero(linked)
            pairs.append((a + low, b + low))
        if not pairs:
            return None
        a, b = (np.concatenate(v) for v in zip(*pairs, strict=True))
        if part.min() != part.max():
            a, b = a[part[a] != part[b]], b[part[a] != part[b]]
        if len(a):
            new = ~shared(before, a, b)
            a, b = a[new], b[new]
        if not len(a):
            return None
        links = np.zeros(n, np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        hit = np.flatnonzero(links)
        tree = forest(n, a, b)
        return ids[hit], links[hit], ids[[p for p, _ in tree]], ids[[q for _, q in tree]]

    def run(batches):
        found, held, last = [], [], None

        def settle():
            if sum(len(h[0]) for h in held) > 1:
                ids, copies, part, here, before, x = zip(*held, strict=True)
                made = solve(*map(np.concatenate, (ids, copies, part)), sum(here, []), sum(before, []), np.concatenate(x))
                if made is not None:
                    found.append(made)

        def out():
            got, none = [np.concatenate(c) for c in zip(*found, strict=True)], lambda n: pa.nulls(n, pa.int64())
            found.clear()
            hit, links, a, b = got
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([hit, a])), pa.concat_arrays([none(len(hit)), pa.array(b)]), pa.concat_arrays([pa.array(links), none(len(a))])], names=["vec_id", "other", "n_links"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in _SENT[:5]), strict=True))
            ids, copies, part = (batch.column(c).to_numpy() for c in ("vec_id", "copies", "part"))
            here, before, vectors = batch.column("here").to_pylist(), batch.column("before").to_pylist(), batch.column("embedding")
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))])
            low = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[low]:
                    continue
                if keys[low] != last:
                    settle()
                    held, last = [], keys[low]
                    if len(found) > 500:
                        yield out()
                held.append((ids[low:k], copies[low:k], part[low:k], here[low:k], before[low:k], flat[at[low] : at[k]].astype(float).reshape(k - low, -1)))
                low = k
        settle()
        if found:
            yield out()

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, they are equally long, and their cosine is cosine or more. Null, empty and zero vectors, and those
    with null or non-finite components, link with nothing. component_id: smallest id that links reach, itself included; kept: vec_id = component_id.
    Null or repeated ids: each row is a vector of its own, in the order of ids, nulls last. No rows: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # floats travel as floats; all sums are in double
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
    base, names = unique_ids(base, "vec_id", "label", "embedding")
    keyed = table(base.where("label is not null").mapInArrow(_key_rows, "vec_id long, label string, dim int, k1 long, k2 long"))
    classes = table(keyed.groupBy("label", "dim", "k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    firsts = classes.join(sizes, ["label", "dim"]).select(F.col("first").alias("vec_id"), "dim", "copies", "n").join(base, "vec_id")
    rows = table(firsts.mapInArrow(_filters, f"vec_id long, label string, dim int, copies long, words int, filters array<long>, embedding array<{kind}>"))
    each = rows.select("vec_id", "label", "dim", F.explode("filters").alias("filter"))
    hot = table(each.groupBy("label", "dim", "filter").agg(F.count("*").alias("m")).where(F.col("m") > PART).select("label", "dim", "filter", F.ceil(F.col("m") / PART).cast("int").alias("parts")))
    met = each.join(hot, ["label", "dim", "filter"]).groupBy("vec_id").agg(F.collect_list(F.struct("filter", "parts")).alias("met"))  # at most a vector's filters
    met = met.select("vec_id", F.col("met.filter").alias("hot"), F.col("met.parts").alias("parts"))
    sent = rows.join(met, "vec_id", "left").mapInArrow(_send, f"label string, dim int, block long, p int, q int, vec_id long, copies long, part int, here binary, before binary, embedding array<{kind}>")
    found = table(sent.repartition(n, *_SENT[:5]).sortWithinPartitions(*_SENT[:5]).mapInArrow(_verify(cosine), "vec_id long, other long, n_links long"))
    links = found.where("other is null").groupBy("vec_id").agg(F.sum("n_links").alias("links")).withColumnRenamed("vec_id", "l_id")
    linked = components(found.where("other is not null").select(F.col("vec_id").alias("u"), F.col("other").alias("v"))).withColumnRenamed("id", "c_id")
    classed = classes.join(links, F.col("first") == F.col("l_id"), "left").join(linked, F.col("first") == F.col("c_id"), "left")
    classed = classed.select("label", "dim", "k1", "k2", F.coalesce("component", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = keyed.join(classed, ["label", "dim", "k1", "k2"]).select(F.col("vec_id").alias("s_id"), "component_id", "n_links")
    result = base.select("vec_id").join(known, F.col("vec_id") == F.col("s_id"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return old_ids(result.withColumn("kept", F.col("vec_id") == F.col("component_id")), names, ["vec_id", "component_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON v.vec_id = l.u LEFT JOIN degree d ON v.vec_id = d.u
"""
