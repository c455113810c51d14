"""The trie of conversation prefixes, by prefix doubling: equal blocks of turns get equal dense names, without comparing sequences.

Each different turn gets a dense name. A block of 2^k turns, at a multiple of 2^k, is a pair of names of half the length, and pairs get dense names in turn: a
logarithmic number of rounds, each half as large as the one before. A prefix of d turns is cut into such blocks by the bits of d, so prefixes
are named from the longest blocks down: the prefix of (2m + 1) 2^k turns is the pair of the prefix of 2m 2^k turns and the next block of 2^k. Each
prefix is named once, and equal names are equal prefixes, that is one node of the trie.

Sums over a subtree need no walk: a node's smallest member is its owner, each node below has its owner among the members, so what owners hold from the node's depth on, summed over
the members, counts each node of the subtree once. Names are found by grouping with map-side combine and looked up with hot names apart (common.lookup); sums along a conversation are taken in
spans of SPAN turns, then over the spans; ids of a node that holds many conversations are joined to long strings in sorted ranges before one task hashes them in a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import files_of, lookup, numbered, partitions, table

#: Conversations of a family (ids with one quotient) share the first turns of the family's first; HEADS - 1 turns at most.
FAMILY, HEADS = 20, 4
#: Turns of a conversation that one group sums.
SPAN = 256
#: Bytes of ids in a row, about.
_CHUNK = 1 << 18


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, turn_key, words, size) of each turn of the conversations that have an id: pos from 0 by turn (null first; equal ones by role, then text), size the turns of conv. Written."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    ties = rows.groupBy("conv", "turn").count().where("count > 1").limit(1).count()
    key = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    rows = rows.select("conv", "turn", *(["role", "text"] if ties else []), key.alias("turn_key"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    rows = table(numbered(rows, [F.col("conv"), F.col("turn").asc_nulls_first(), *([F.col("role"), F.col("text")] if ties else [])]).drop("turn", "role", "text"))
    sizes = table(rows.groupBy("conv").agg(F.min("_seq").alias("at"), F.count("*").alias("size")))
    return table(lookup(rows, sizes, ["conv"], "size").select("conv", (F.col("_seq") - F.col("at")).alias("pos"), "turn_key", "words", "size"))


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, turn_key, words, len) of the rebuilt conversations, (conv, len) of all), from ordered_turns().

    Conversation c is rebuilt of the first h = crc32(c in decimal) mod 4 turns of c - c % 20 and its own turns after its first h.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    first = F.col("conv") - F.col("conv") % FAMILY
    convs = turns.where("pos = 0").select("conv", "size", h.alias("h"), first.alias("head"))
    convs = convs.join(convs.select(F.col("conv").alias("head"), F.col("size").alias("has")), "head", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    convs = table(convs.withColumn("len", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))))
    own = lookup(turns.drop("size"), convs, ["conv"], "size").where("pos >= h").select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "turn_key", "words", "len")
    heads = turns.where((F.col("pos") < HEADS - 1) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("head"), "pos", "turn_key", "words")
    taken = convs.join(heads, "head").where("pos < h").select("conv", "pos", "turn_key", "words", "len")  # at most three rows a conversation
    return table(own.union(taken)), convs.select("conv", "len")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As shared_heads(), of the conversations as they are."""
    return turns.withColumnRenamed("size", "len"), turns.where("pos = 0").select("conv", F.col("size").alias("len"))


def _named(rows: DataFrame, keys: list[str], files: int, start: int = 0, **more: Column) -> tuple[DataFrame, int]:
    """(rows, a written table, with name and more: one dense number for each different value of keys, from start; the first number left)."""
    found = table(rows.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(a) for a, c in more.items()]).coalesce(files).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = found.groupBy(part.alias("_p")).agg(F.count("*").alias("_k"))  # one row a partition
    offsets = sizes.select("_p", (F.sum("_k").over(Window.orderBy("_p")) - F.col("_k") + F.lit(start)).alias("_o"))
    names = found.join(F.broadcast(offsets), part == F.col("_p")).withColumn("name", F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1))
    return table(lookup(rows, names.drop("_m", "_p", "_o"), keys).coalesce(files)), start + found.count()


def named_prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, len, name, owner, n, ends) of each prefix of a turn or more of turns(conv, pos, turn_key, words, len), a written table.

    name: dense, from 1, the same for equal prefixes; owner: smallest conversation with the prefix; n, ends: how many have it, and end with it.
    """
    longest, total = turns.agg(F.max("len"), F.count("*")).first()
    longest = longest or 0
    files = lambda k: files_of(turns.sparkSession, total >> k)  # noqa: E731  there are total / 2^k blocks of 2^k turns, and prefixes that end with one, at most
    blocks = [_named(turns.select("conv", F.col("pos").alias("j"), "turn_key", "len"), ["turn_key"], files(0))[0].select("conv", "j", "len", "name")]
    while (1 << len(blocks)) <= longest:
        halves = blocks[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(F.max("len").alias("len"), *[F.max(F.when(F.col("j") % 2 == k, F.col("name"))).alias(f"half{k}") for k in (0, 1)])
        k = len(blocks)
        pairs = table(halves.where("half0 is not null and half1 is not null").coalesce(files(k)))
        blocks.append(_named(pairs, ["half0", "half1"], files(k))[0].select("conv", "j", "len", "name"))
    done, next_name = None, 1
    for k in reversed(range(len(blocks))):
        even = blocks[k].where(F.col("j") % 2 == 0).select("conv", (F.col("j") * (1 << k)).alias("start"), "len", F.col("name").alias("block"))
        begun = even.where("start = 0").withColumn("prefix", F.lit(0).cast("long"))
        if done is not None:
            begun = begun.unionByName(even.where("start > 0").join(done.select("conv", F.col("depth").alias("start"), F.col("name").alias("prefix")), ["conv", "start"]))
        rows = table(begun.select("conv", (F.col("start") + (1 << k)).alias("depth"), "len", "prefix", "block").coalesce(files(k)))
        made, next_name = _named(rows, ["prefix", "block"], files(k), next_name, owner=F.min("conv"), ends=F.count_if(F.col("depth") == F.col("len")))
        made = made.select("conv", "depth", "len", "name", "owner", "n", "ends")
        done = made if done is None else done.unionByName(made)
    return done


def _chunks(batches):
    """Sorted rows (node, conv): (node, first conv, ids joined by commas) of up to about _CHUNK bytes."""
    node, first, ids, size = None, None, [], 0
    for batch in batches:
        for a, c in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (a != node or size > _CHUNK):
                yield pa.RecordBatch.from_pydict({"node": [node], "conv": [first], "ids": [",".join(ids)]})
                ids, size = [], 0
            if not ids:
                node, first = a, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield pa.RecordBatch.from_pydict({"node": [node], "conv": [first], "ids": [",".join(ids)]})


def _digests(batches):
    """Sorted chunks: (node, SHA-256 of all its ids joined by commas), hashed as they come."""
    node, sha, out = None, None, []
    for batch in batches:
        for a, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if sha is None or a != node:
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = a, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], names=["node", "sha"])
            out = []
    if sha is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "sha": [sha.hexdigest()]})


def digests(ends: DataFrame) -> DataFrame:
    """(node, sha) of ends(node, conv): lower-case SHA-256 of the convs of a node in decimal, ascending, comma-joined."""
    n = partitions(ends.sparkSession)
    chunks = ends.repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_chunks, "node long, conv long, ids string")
    return chunks.repartition(n, "node").sortWithinPartitions("node", "conv").mapInArrow(_digests, "node long, sha string")


def prefix_trie(turns: DataFrame, rebuild=whole, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rebuild: from ordered_turns(), the turns whose trie is built, and all conversations (shared_heads, or whole: the conversations as they are). Turns of
    equal number are ordered by role and text; a null number comes first, a null role or text is empty. Rows without a conversation's id belong to none and are left
    out. Repeated rows are turns of their own. No conversations: no rows, not even a root. Other columns are ignored.
    """
    rows, convs = rebuild(ordered_turns(turns, conv_col, turn_col, role_col, text_col))
    prefixes = named_prefixes(rows)
    all_ = convs.agg(F.min("conv"), F.count("*"), F.count_if(F.col("len") == 0)).first()
    least, total, empty = all_[0], all_[1], all_[2]
    number = lambda x: F.lit(x).cast("long")
    root = convs.select("conv", number(0).alias("depth"), "len", number(0).alias("name"), number(least).alias("owner"), number(total).alias("n"), number(empty).alias("ends"), number(0).alias("words"))
    at = prefixes.join(rows.select("conv", (F.col("pos") + 1).alias("depth"), "words"), ["conv", "depth"]).unionByName(root)
    owned = F.col("conv") == F.col("owner")
    leaf = owned & (F.col("depth") == F.col("len")) & (F.col("ends") == F.col("n"))
    at = table(at.select("*", F.floor(F.col("depth") / SPAN).alias("span"), F.when(owned, 0).otherwise(F.col("words")).cast("long").alias("saved"), F.when(leaf, 1).otherwise(0).cast("long").alias("leaf")))
    later = Window.partitionBy("conv").orderBy(F.desc("span"))  # one row for SPAN turns
    spans = at.groupBy("conv", "span").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    spans = spans.select("conv", "span", (F.sum("s").over(later) - F.col("s")).alias("s"), (F.sum("l").over(later) - F.col("l")).alias("l"))
    within = Window.partitionBy("conv", "span").orderBy(F.desc("depth"))
    sums = at.select("conv", "span", "depth", "name", "owner", "n", F.sum("saved").over(within).alias("saved"), F.sum("leaf").over(within).alias("leaf")).join(spans, ["conv", "span"])
    nodes = sums.groupBy("name").agg(*[F.min(c).alias(c) for c in ("owner", "depth", "n")], F.sum(F.col("leaf") + F.col("l")).alias("n_leaves"), F.sum(F.col("saved") + F.col("s")).alias("saved_tokens"))
    up = at.where(owned & (F.col("depth") > 0)).select("name", F.col("owner").alias("conv"), (F.col("depth") - 1).alias("depth"))
    up = table(up.join(at.select("conv", "depth", F.col("name").alias("parent"), F.col("owner").alias("parent_conv_id")), ["conv", "depth"]).select("name", "parent", "parent_conv_id"))
    children = up.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    sha = digests(at.where("depth = len").select(F.col("name").alias("node"), "conv")).withColumnRenamed("node", "name")
    out = nodes.join(up.drop("parent"), "name", "left").join(children, "name", "left").join(sha, "name", "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", number(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shared_heads)


SQL = r"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 20 AS head, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
 lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM o)),
parts AS (SELECT i.c, 0 AS half, o.pos, role, text FROM ids i JOIN o ON o.c = i.head AND o.pos < i.h UNION ALL SELECT i.c, 1, o.pos, role, text FROM ids i JOIN o ON o.c = i.c AND o.pos >= i.h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY half, pos) AS d, sha256(length(role)::VARCHAR || ':' || role || ':' || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM parts),
sizes AS (SELECT i.c, coalesce(max(d), 0) AS len FROM ids i LEFT JOIN turns t USING (c) GROUP BY i.c),
pre AS (SELECT c, d, sha256(string_agg(k, ',' ) OVER (PARTITION BY c ORDER BY d)) AS node, words FROM turns UNION ALL SELECT c, 0, '', 0 FROM ids),
nodes AS (SELECT d, node, min(c) AS owner, count(*) AS n, max(words) AS words, string_agg(CASE WHEN d = len THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM pre JOIN sizes USING (c) GROUP BY d, node),
up AS (SELECT v.d, v.node, u.d AS pd, u.node AS pnode FROM nodes v JOIN pre u ON u.c = v.owner AND u.d = v.d - 1),
kids AS (SELECT pd AS d, pnode AS node, count(*) AS k FROM up GROUP BY ALL),
full_nodes AS (SELECT v.*, coalesce(k, 0) AS k FROM nodes v LEFT JOIN kids USING (d, node)),
below AS (SELECT u.d, u.node, sum((v.n - 1) * v.words)::BIGINT AS saved, count(*) FILTER (v.k = 0) AS leaves FROM full_nodes v JOIN pre u ON u.c = v.owner AND u.d <= v.d GROUP BY ALL)
SELECT v.owner AS conv_id, v.d::BIGINT AS depth, p.owner AS parent_conv_id, v.n AS n_convs, v.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM full_nodes v JOIN below b ON v.d = b.d AND v.node = b.node LEFT JOIN up ON up.d = v.d AND up.node = v.node LEFT JOIN nodes p ON p.d = up.pd AND p.node = up.pnode
"""
