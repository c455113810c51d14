"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Pieces are dealt by their place in the table to shards of about SHARD pieces, so that a shard's bins fit in one task whatever the number of documents, and rows alike in id and length are spread. A shard packs its pieces in
falling length: each goes to the open bin that it fills best; else a bin is opened at the least-cost permitted size for the
policy in force. Every permitted length is tried as the policy's smallest opening size; each outcome is downsized (every bin to the
smallest size that holds its contents) and the cheapest is kept. A bin costs its length plus OVERHEAD. Documents longer than the largest
length are cut into pieces of that length and a rest; nothing is lost. The unit is that of the given lengths: tokens of the piece vocabulary in the query and in the pipeline.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, old_ids, partitions, table
from .op05_token_counts import token_counts
from .op07_nbest import encode
from .piece_lattice import DEFAULT_MODEL
from .textkernel import trimmed

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD = 8192


def best_fit(lengths: Sequence[int], sizes: Sequence[int], least: int) -> tuple[list[int], list[int]]:
    """(bin of each piece, size each bin was opened at); lengths fall. New bins have the cheapest size of least or more that holds the piece."""
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with room r is open
    where, opened = [], []
    for n in lengths:
        up = rooms >> n
        if up:
            room = n + (up & -up).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((s for s in sizes if s >= n and s >= least), default=max(sizes))
            k = len(opened)
            opened.append(room)
        where.append(k)
        room -= n
        if room:
            by_room.setdefault(room, []).append(k)
            rooms |= 1 << room
    return where, opened


def pack(lengths: Sequence[int], sizes: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """(bin of each piece, final size of each bin): the cheapest outcome over all opening policies, after downsizing."""
    sizes = sorted(sizes)
    best = None
    for least in sizes:
        where, opened = best_fit(lengths, sizes, least)
        filled = np.bincount(where, lengths, minlength=len(opened)).astype(int) if len(where) else np.zeros(0, int)
        final = np.array(sizes)[np.searchsorted(sizes, filled)] if len(filled) else filled
        cost = int(final.sum()) + overhead * len(final)
        if best is None or cost < best[0]:
            best = (cost, where, final.tolist())
    return best[1], best[2]


def _shard(sizes: Sequence[int], overhead: int):
    def solve(shard, rows):
        rows.sort(key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]))
        where, final = pack([r[2] for r in rows], sizes, overhead)
        at = [0] * len(final)
        for r, k in zip(rows, where, strict=True):
            yield r[0], r[1], r[2], (shard << 32) | k, at[k], final[k]
            at[k] += r[2]

    def run(batches):
        shards: dict[int, list] = {}
        for b in batches:
            for shard, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "piece", "length")), strict=True):
                shards.setdefault(shard, []).append(row)
        for shard in sorted(shards):
            cols = list(zip(*solve(shard, shards.pop(shard)), strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "length", "bin_id", "bin_start", "capacity"])

    return run


def best_fit_packing(items: DataFrame, sizes: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, id_col: str = "doc_id", length_col: str = "length") -> DataFrame:
    """One row per piece: doc_id, piece (0, 1, ... of its document), length, bin_id, bin_start (place in the bin), capacity (the bin's final length).

    Lengths that are null, zero or negative: one row with length 0 and no bin. Ids may be null or repeat: each row is packed. Ties are packed in
    the order of ids, nulls last; rows alike in id and length are interchangeable. No rows: no rows. Other columns are ignored.
    """
    spark = items.sparkSession
    most = max(sizes)
    base = items.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("length"))
    number = F.greatest(F.ceil(F.col("length") / most), F.lit(1)).cast("int")
    # the place is written with the rows, so it stays when a task runs again
    cut = table(base.select("doc_id", "length", F.monotonically_increasing_id().alias("place"), F.explode(F.sequence(F.lit(0), number - 1)).alias("piece")).select("doc_id", "piece", "place", F.least(F.col("length") - F.col("piece").cast("long") * most, F.lit(most).cast("long")).alias("length")))
    some = cut.where("length > 0")
    shards = max(1, -(-some.count() // SHARD))
    dealt = some.withColumn("shard", F.pmod(F.xxhash64("place", "piece"), F.lit(shards)))
    packed = dealt.repartition(min(shards, max(partitions(spark), shards // 8)), "shard").mapInArrow(trimmed(_shard(tuple(sizes), overhead)), "doc_id long, piece int, length long, bin_id long, bin_start long, capacity long")
    none = F.lit(None).cast("long")
    return packed.unionByName(cut.where("length = 0").select("doc_id", "piece", "length", none.alias("bin_id"), none.alias("bin_start"), none.alias("capacity")))


def token_lengths(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, length: tokens of the whole text by the piece vocabulary (null and empty texts: 0). Ids may be null or repeat. Other columns are ignored. No rows: no rows."""
    return token_counts(docs, model).select("doc_id", F.col("n_tokens").alias("length"))


def packed_sequences(docs: DataFrame, sizes: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, model: str = DEFAULT_MODEL) -> DataFrame:
    """best_fit_packing() of the texts of docs(doc_id, text) in tokens, with row_id and token_ids, the tokens of the piece: what a trainer reads, bin by bin.

    row_id tells documents with one id apart: it is doc_id where ids are unique and not null, else the number of the row in the order (id, nulls last, text). Null
    and empty texts: one row without tokens. No rows: no rows. Other columns are ignored.
    """
    rows, names = boxed(docs)
    encoded = table(encode(rows, 1, model).select("doc_id", "ids"))  # the best segmentation
    lengths = rows.select("doc_id").join(encoded.select("doc_id", F.size("ids").alias("length")), "doc_id", "left")
    most = max(sizes)
    at = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / most).cast("int"))
    pieces = encoded.where(F.size("ids") > 0).select("doc_id", F.posexplode(F.transform(at, lambda k: F.slice("ids", k * most + 1, most))).alias("piece", "token_ids"))
    packed = best_fit_packing(lengths, sizes, overhead).join(pieces, ["doc_id", "piece"], "left").withColumn("row_id", F.col("doc_id"))
    none = F.array().cast("array<int>")
    return old_ids(packed.withColumn("token_ids", F.coalesce("token_ids", none)), names, ["doc_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
