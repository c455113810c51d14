"""Encoding with the N best segmentations of each document over a piece vocabulary, and decoding.

Forward Viterbi scores come from the shared trie of a slice's distinct pre-tokens, with the second best beside the best. A document's N best
segmentations change at most N - 1 pre-tokens, those whose second best is nearest to the best; only for these the backward A-star search
runs, with the forward scores as its exact heuristic, and a heap combines their lists. Whole texts, no shuffle, memory
bounded by a slice of texts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .piece_lattice import DEFAULT_MODEL, LONGEST, PieceTable, Trie, load, nbest, pretokens
from .textkernel import trimmed

N_BEST = 3
#: Bytes of the lists of segmentations that a task remembers, about.
REMEMBERED = 32 << 20


def combine(lists: list[list[tuple[float, list[int]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best choices of one entry from each list, by sum: (distance to the best, entry numbers). Lists fall; ties: earlier entries of later lists."""
    drop = [[x[0][0] - s for s, _ in x] for x in lists]
    start = (0,) * len(lists)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        d, at = heapq.heappop(heap)
        out.append((d, at))
        for k in range(len(at)):
            if at[k] + 1 < len(drop[k]):
                to = (*at[:k], at[k] + 1, *at[k + 1 :])
                if to not in seen:
                    seen.add(to)
                    heapq.heappush(heap, (sum(drop[j][i] for j, i in enumerate(to)), to))
    return out


def _run(shared, n: int, with_text: bool):
    def run(batches):
        table: PieceTable = shared.value
        known: dict[bytes, list] = {}
        held = 0

        def lists(word: bytes):
            nonlocal held
            got = known.get(word)
            if got is None:
                got = nbest(word, table, n)
                size = 200 + len(word) + sum(100 + 8 * len(ids) for _, ids in got)
                if held + size > REMEMBERED:
                    known.clear()
                    held = 0
                if size <= REMEMBERED >> 4:
                    known[word] = got
                    held += size
            return got

        for batch in batches:
            ids_col = batch.column("doc_id")
            for a, b, d, starts, ends, row, ranges in pretokens(batch, most=1 << 19):
                _, first, of = np.unique(ranges.hashes(starts, ends), return_index=True, return_inverse=True)
                s, e = starts[first], ends[first]
                short = np.flatnonzero(e - s <= LONGEST)
                trie = Trie(d, ranges, s[short], e[short], table)
                score, gap, count = np.zeros(len(s)), np.zeros(len(s)), np.zeros(len(s), np.int64)
                count[short], score[short], gap[short] = trie.terminals()
                ids, offsets = trie.segmentations()
                begin = np.zeros(len(s), np.int64)
                begin[short] = offsets[:-1]
                extra, size = [ids], len(ids)
                for k in np.flatnonzero(e - s > LONGEST):
                    got = lists(d[s[k] : e[k]].tobytes())
                    score[k], count[k], begin[k] = got[0][0], len(got[0][1]), size
                    gap[k] = got[0][0] - got[1][0] if len(got) > 1 else np.inf
                    extra.append(np.array(got[0][1], np.int64))
                    size += count[k]
                ids = np.concatenate(extra)
                many = count[of]
                ends_of = np.cumsum(many)
                best = ids[np.repeat(begin[of] - (ends_of - many), many) + np.arange(int(ends_of[-1]))]
                total = np.bincount(row, score[of], minlength=b - a)
                at = np.searchsorted(row, np.arange(b - a + 1))
                out: list[list] = [[], [], [], []]
                for k in range(b - a):
                    lo, hi = int(at[k]), int(at[k + 1])
                    if lo == hi:
                        continue
                    base = int(ends_of[lo] - many[lo])
                    own = best[base : int(ends_of[hi - 1])]
                    g = gap[of[lo:hi]]
                    m = min(n - 1, hi - lo)
                    near = np.sort(np.argpartition(g, m - 1)[:m]) if 0 < m < hi - lo else np.arange(m)
                    near = near[np.isfinite(g[near])]
                    choices = [lists(d[starts[lo + j] : ends[lo + j]].tobytes()) for j in near.tolist()]
                    for rank, (drop, entry) in enumerate(combine(choices, n) if len(choices) else [(0.0, ())]):
                        mine, done, to = [], 0, own
                        if any(entry):
                            for j, i, c in zip(near.tolist(), entry, choices, strict=True):
                                if i:
                                    f = int(ends_of[lo + j] - many[lo + j]) - base
                                    mine += [own[done:f], np.array(c[i][1], np.int64)]
                                    done = f + int(many[lo + j])
                            to = np.concatenate([*mine, own[done:]])
                        for c, v in zip(out, (a + k, rank + 1, total[k] - drop, to), strict=True):
                            c.append(v)
                if not out[0]:
                    continue
                lengths = np.cumsum([0, *map(len, out[3])])
                joined = np.concatenate(out[3])
                arrays = pa.ListArray.from_arrays(pa.array(lengths.astype(np.int32)), pa.array(joined.astype(np.int32)))
                text = [pa.array(table.decode(joined, lengths), pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([ids_col.take(pa.array(out[0])), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64()), arrays, *text], names=["doc_id", "rank", "score", "ids", *(["text"] if with_text else [])])

    return run


def encode(docs: DataFrame, n: int = N_BEST, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """The n best segmentations of each text: doc_id, rank (from 1), score, ids; fewer rows where a text has fewer segmentations.

    with_text: also text, what decode() makes of the ids, in the same pass.

    Null and empty texts have no row. Ids may be null or repeat. Ties between segmentations are broken by the order of the search,
    which depends on the text alone. Other columns are ignored. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(trimmed(_run(shared, n, with_text)), "doc_id long, rank int, score double, ids array<int>" + ", text string" * with_text)


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with ids replaced by their text, without the space that encoding adds in front.

    Null ids, null elements and ids outside the vocabulary give null; control ids (begin, end, padding) are nothing, the unknown id is a double question mark, bytes that are no UTF-8
    are replaced. No rows: no rows; a column with the name of text_col is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))
    names = [c for c in encoded.columns if c not in (ids_col, text_col)]

    def run(batches):
        table: PieceTable = shared.value
        for b in batches:
            lists = b.column(ids_col)
            kind = lists.type.value_type
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            values = pc.fill_null(pc.list_flatten(lists).cast(kind), -1).to_numpy(zero_copy_only=False)
            found = table.decode(values, offsets)
            out = [x if ok else None for x, ok in zip(found, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.string())], names=[*names, text_col])

    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names), f"`{text_col}` string"])
    return encoded.select(*names, ids_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text and rank: the number of ids, the score, a hash of the ids and one of the text that they decode to."""
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=True)
    return found.select("doc_id", "rank", F.round("score", 6).alias("score"), F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.xxhash64("text").alias("text_hash"))
