"""Token counts of documents under a unigram piece model, by trie-shared dynamic programming.

Each task collects the distinct pre-tokens it has not met before, puts them in a trie and computes the forward scores of every shared prefix
once; terminal nodes hold the token counts, which are then looked up for each occurrence and summed by document. What a task
remembers is bounded by REMEMBERED pre-tokens. Pre-tokens over LONGEST bytes (a script without spaces, encoded data) would fill the trie with prefixes that nothing shares: the same
forward pass runs over each by itself. No shuffle: documents are independent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .piece_lattice import DEFAULT_MODEL, LONGEST, Lattice, PieceTable, Trie, load, pretokens
from .textkernel import _U, trimmed

REMEMBERED = 1_000_000


def _run(shared):
    def run(batches):
        table: PieceTable = shared.value
        keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        for batch in batches:
            tokens, words = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b, d, starts, ends, row, ranges in pretokens(batch):
                h, first, of = np.unique(ranges.hashes(starts, ends), return_index=True, return_inverse=True)
                at = np.searchsorted(keys, h)
                new = np.ones(len(h), bool)
                inside = at < len(keys)
                new[inside] = keys[at[inside]] != h[inside]
                n = np.zeros(len(h), np.int64)
                n[~new] = counts[at[~new]]
                s, e = starts[first[new]], ends[first[new]]
                fresh = np.zeros(len(s), np.int64)
                short = e - s <= LONGEST
                fresh[short] = Trie(d, ranges, s[short], e[short], table).terminals()[0]
                for k in np.flatnonzero(~short):
                    fresh[k] = len(Lattice(d[s[k] : e[k]].tobytes(), table).best())
                n[new] = fresh
                if len(keys) + len(fresh) > REMEMBERED:
                    keys, counts = h, n
                else:
                    keys, counts = np.insert(keys, at[new], h[new]), np.insert(counts, at[new], fresh)
                tokens[a:b] = np.bincount(row, n[of], minlength=b - a).astype(np.int64)
                words[a:b] = np.bincount(row, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens of the best segmentation of the whole text.

    Null and empty texts: 0. Ids may be null or repeat. Bytes that no piece covers count one token each. Other columns are ignored. No
    rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(trimmed(_run(shared)), "doc_id long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
