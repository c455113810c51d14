"""Exact removal of byte strings that occur earlier: suffix arrays over the regions around repeated anchors.

Every window of `length` bytes is assigned one anchor, the position of its smallest gram hash (a minimizer): equal windows
get equal anchors, so a window can only repeat where its anchor's gram repeats. Anchors that occur once are settled by a
count. Consecutive windows with one anchor share a context, the bytes that they cover: all but the first of equal contexts
are repeats entirely, and leave the job as byte ranges, first within a task (so that a hot passage sends one row a task), then
by anchor.

Anchors with more different contexts than a shard holds are split by content, not by document: the windows of a context whose place
relative to the anchor lies in one interval of INTERVAL places share length - INTERVAL + 1 bytes, and these bytes are their new key. Equal windows
have equal keys, so nothing has to be merged between keys; keys that occur once are settled again, as are equal contexts. Anchors with
many contexts are found in a sample of the documents beforehand (it steers the plan and changes no result) and dealt by context.

Where different contexts share an anchor or key (the edges of copies), suffix arrays are built: contexts are dealt to
shards by key; in each shard Larsson-Sadakane refinement in numpy sorts the suffixes, Kasai's rule yields the common prefixes, and runs of
suffixes that share `length` bytes keep their earliest. A key that still has more contexts than a shard holds is dealt to several shards,
and the run tables of its shards are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import old_ids, partitions, table, unique_ids
from .textkernel import _BASE, flat, mix, pieces, trimmed

_U = np.uint64
#: Bytes of a gram whose hash picks the anchors.
GRAM = 24
#: Contexts of one anchor in one shard at most; larger groups are split.
SHARD_CONTEXTS = 1024
#: Places of a window relative to its anchor in one part of a split context.
INTERVAL = 8
#: Share of the documents whose anchors are counted to find hot ones, and the number of hot anchors at most: those beyond hold less than 1 / HOT of all rows each
#: and are streamed in order of their contexts, so they need time in one task but no memory.
SAMPLE, HOT = 1 / 32, 10_000
#: Bytes sorted at once in a shard; whole anchor groups, so one may exceed it.
SORT_BYTES = 1 << 20
#: Rows held by a task before its repeated contexts are settled.
HELD_ROWS = 300_000
#: Rows of whole anchors that a task takes at once.
CHUNK = 500_000
_BITS = 21


def _gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of data[i : i + width], width a multiple of 8."""
    h = data.astype(_U) + _U(1)
    size = 1
    while size < 8:
        h = h[:-size] * _U(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    n = len(data) - width + 1
    out = h[:n].copy()
    for at in range(8, width, 8):
        out *= _U(pow(_BASE, 8, 1 << 64))
        out += h[at : at + n]
    return mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: row, first window's position in the row, number of windows, gram hash, context hash."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    keys = _gram_hashes(data, gram)
    mask = _U((1 << _BITS) - 1)
    anchor = (_sliding_min((keys & ~mask) | np.arange(len(keys), dtype=_U), length - gram + 1) & mask).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    np.add.at(inside, np.clip(inner - length + 1, 0, n), 1)
    np.add.at(inside, np.minimum(inner, n), -1)
    valid = np.cumsum(inside[:-1]) == 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    end = np.flatnonzero(last)
    row = np.searchsorted(offsets, start, "right") - 1
    view = memoryview(data)
    digest = xxhash.xxh3_64_intdigest
    context = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), (end + length).tolist(), strict=True)), _U, len(start))
    return row, start - offsets[row], end - start + 1, keys[anchor[start]], context


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, bytes of that row before them): slices of whole rows, or overlapping slices of a long one."""
    most = 1 << (_BITS - 1)
    for a, b in pieces(offsets, 1 << 18):
        part, at = data[offsets[a] : offsets[b]], 0
        if len(part) <= most:
            yield np.ascontiguousarray(part), offsets[a : b + 1] - offsets[a], a, 0
            continue
        while at == 0 or at + length <= len(part):
            x = np.ascontiguousarray(part[at : at + most])
            yield x, np.array([0, len(x)]), a, at
            at += most - length + 1


_ANCHORS = "kh long, ch long, doc_id long, lo int, n int, settled boolean"


def _merged(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window ranges with those that touch in one document made one."""
    o = np.lexsort((lo, doc))
    doc, lo, end = doc[o], lo[o], (lo + n)[o]
    if not len(doc):
        return doc, lo, n
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != end[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(doc)) - 1
    return doc[s], lo[s], end[e] - lo[s]


def _repeats(key: np.ndarray) -> np.ndarray:
    """Indices of the rows whose key occurs more than once."""
    o = np.argsort(key)
    s = key[o]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(key), bool)
    hit[1:] |= same
    hit[:-1] |= same
    return o[hit]


def _settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Anchor rows with the equal contexts of a task made ranges: (kh, ch, doc_id, lo, n, settled)."""
    doc, lo, n, kh, ch = (np.concatenate(x) for x in zip(*held, strict=True))
    at = _repeats(kh ^ mix(ch))
    at = at[np.lexsort((lo[at], doc[at], ch[at], kh[at]))]
    again = np.zeros(len(at), bool)
    again[1:] = (kh[at[1:]] == kh[at[:-1]]) & (ch[at[1:]] == ch[at[:-1]])
    gone = np.zeros(len(doc), bool)
    gone[at[again]] = True
    d, a, m = _merged(doc[gone], lo[gone], n[gone])
    keep = ~gone
    cols = [np.concatenate([kh[keep].view(np.int64), d]), np.concatenate([ch[keep].view(np.int64), np.zeros(len(d), np.int64)]), np.concatenate([doc[keep], d]), np.concatenate([lo[keep], a]).astype(np.int32), np.concatenate([n[keep], m]).astype(np.int32), np.arange(keep.sum() + len(d)) >= keep.sum()]
    for k in range(0, len(cols[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 17)]) for c in cols], names=["kh", "ch", "doc_id", "lo", "n", "settled"])


def _anchor_rows(length: int, gram: int):
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column("text"))
            for part, o, row, skipped in _chunks(data, offsets, length):
                r, lo, n, kh, ch = _contexts(part, o, length, gram)
                if len(r):
                    held.append((ids[row + r], lo + skipped, n, kh, ch))
                    rows += len(r)
                if rows > HELD_ROWS:
                    yield from _settle(held)
                    held, rows = [], 0
        if held:
            yield from _settle(held)

    return run


_RANGES = "doc_id long, lo int, n int, kh long, parts int"


def _by_anchor(batches):
    """Rows in the order of kh, ch, doc_id, lo. Settle equal contexts, pass on the first of each where contexts differ (parts > 0).

    All rows of an anchor are in one task, but for hot ones: there, all rows of a context are, and each first goes on with parts -1. So do
    those of an anchor with more than CHUNK rows: it is never held whole.
    """
    held: list[list[np.ndarray]] = []
    last = long = None  # the context before the held rows, the anchor that is not held whole

    def solve(cols, whole: bool):
        nonlocal last, long
        kh, ch, doc, lo, n, settled, hot = cols
        fresh = np.flatnonzero(~settled)
        k, c = kh[fresh], ch[fresh]
        group, first = np.ones(len(k), bool), np.ones(len(k), bool)
        group[1:] = k[1:] != k[:-1]
        first[1:] = group[1:] | (c[1:] != c[:-1])
        if len(k) and last == (k[0], c[0]):
            first[0] = False
        number = np.cumsum(group) - 1
        kinds = np.bincount(number, first)[number].astype(np.int64) if len(k) else np.zeros(0, np.int64)
        apart = hot[fresh] | (k == long if long is not None else False)
        if not whole and len(k):
            long = k[-1]
            apart |= k == long
        edge = first & (apart | (kinds > 1))
        parts = np.where(apart, -1, -(-kinds // SHARD_CONTEXTS))[edge].astype(np.int32)
        edge, gone = fresh[edge], np.concatenate([np.flatnonzero(settled), fresh[~first]])
        if len(k):
            last = (k[-1], c[-1])
        d, a, m = _merged(doc[gone], lo[gone].astype(np.int64), n[gone].astype(np.int64))
        out = [np.concatenate([d, doc[edge]]), np.concatenate([a, lo[edge]]).astype(np.int32), np.concatenate([m, n[edge]]).astype(np.int32), np.concatenate([d, kh[edge]]), np.concatenate([np.zeros(len(d), np.int32), parts])]
        for at in range(0, len(out[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in out], names=["doc_id", "lo", "n", "kh", "parts"])

    def joined():
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if sum(len(x[0]) for x in held) >= CHUNK:
            cols = joined()
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last anchor may go on
            if cut:
                yield from solve([x[:cut] for x in cols], True)
                held = [[x[cut:] for x in cols]]
            else:
                yield from solve(cols, False)
                held = []
    if held:
        yield from solve(joined(), True)


def _extended(length: int, gram: int, interval: int):
    """Contexts of hot anchors cut to the windows of one interval of places relative to the anchor, with the hash of the bytes that such windows share as key."""

    def run(batches):
        held, rows = [], 0
        for b in batches:
            data, offsets = flat(b.column("text"))
            found, texts = [], []
            for k, (doc, ranges) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("ranges").to_pylist(), strict=True)):
                text = data[offsets[k] : offsets[k + 1]]
                for r in ranges:
                    found.append((doc, r["lo"], r["n"], r["kh"]))
                    texts.append(text[r["lo"] : r["lo"] + r["n"] - 1 + length].tobytes())
            if not found:
                continue
            whole = np.frombuffer(b"".join(texts), np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]])
            keys = _gram_hashes(whole, gram).view(np.int64)
            same = np.flatnonzero(keys == np.repeat(np.array([f[3] for f in found], np.int64), [len(x) for x in texts])[: len(keys)])
            anchor = same[np.searchsorted(same, begin)] - begin
            out: list[list[int]] = [[], [], [], [], []]
            digest = xxhash.xxh3_64_intdigest
            for (doc, lo, n, _), text, p in zip(found, texts, anchor.tolist(), strict=True):
                for i in range((p - n + 1) // interval, p // interval + 1):
                    most, least = min((i + 1) * interval - 1, p), max(i * interval, p - n + 1)
                    a, e = p - most, p - least  # first and last window
                    common = text[p - i * interval : p - (i + 1) * interval + 1 + length]
                    for c, v in zip(out, (doc, lo + a, e - a + 1, digest(common, i + 1), digest(text[a : e + length])), strict=True):
                        c.append(v)
            held.append((np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.int64), np.array(out[3], _U), np.array(out[4], _U)))
            rows += len(out[0])
            if rows > HELD_ROWS:
                yield from _settle(held)
                held, rows = [], 0
        if held:
            yield from _settle(held)

    return run


def suffix_array(text: np.ndarray, depth: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts in the order of text[s : s + depth], group of each start) by Larsson-Sadakane refinement.

    A suffix's number is the place of the first member of its group. Groups sorted to h symbols are refined to twice that by
    the numbers h places on; suffixes alone in a group are settled and leave the work. starts need depth bytes after them.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(n, _U)
    for i in range(8):
        words = (words << _U(8)) | padded[i : i + n].astype(_U)
    order = np.argsort(words)
    number = np.empty(n + 1, np.int64)
    number[n] = -1
    h = 8

    def heads(keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return new

    slots = np.arange(n)
    new = heads(words[order])
    number[order] = slots[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    work = order
    while h * 2 <= depth and len(work):
        alone = new & np.append(new[1:], True)
        work, slots = work[~alone], slots[~alone]
        key = (number[work] << 32) | (number[np.minimum(work + h, n)] + 1)
        o = np.argsort(key)
        work = work[o]
        new = heads(key[o])
        number[work] = slots[np.maximum.accumulate(np.where(new, np.arange(len(work)), 0))]
        h *= 2
    key = (number[starts] << 32) | (number[starts + depth - h] + 1)  # the last step reaches exactly depth
    o = np.argsort(key)
    group = np.empty(len(starts), np.int64)
    group[o] = np.cumsum(heads(key[o])) - 1
    return o, group


def common_prefixes(text: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, group: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, depth at most, of each suffix in order and the one before it, by Kasai's rule.

    Dropping the first symbol shortens a common prefix by one at most, so each context (count suffixes from index first) carries its
    length from suffix to suffix; all contexts advance in step. The rule needs the successors of both suffixes in order: after
    a prefix of full depth, where ties are in any order, or the last suffix of a context, the next is counted anew, unless the
    group numbers show that it is full.
    """
    final = np.zeros(len(starts) + 1, bool)
    final[first + count - 1] = True
    before = np.full(len(starts), -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(len(starts), np.int64)
    carried = np.zeros(len(first), np.int64)
    longest = np.argsort(-count, kind="stable")
    for t in range(int(count.max()) if len(count) else 0):
        c = longest[: np.searchsorted(-count[longest], -t, "left")]
        i = first[c] + t
        j = before[i]
        h = np.maximum(carried[c] - 1, 0)
        full = (j >= 0) & (group[i] == group[j])
        h[full] = depth
        h[j < 0] = 0
        go = np.flatnonzero((j >= 0) & ~full)
        while len(go):
            go = go[h[go] < depth]
            same = text[starts[i[go]] + h[go]] == text[starts[j[go]] + h[go]]
            go = go[same]
            h[go] += 1
        out[i] = h
        carried[c] = np.where((h >= depth) | (j < 0) | final[j], 0, h)
    return out[order]


_MARKS = "doc_id long, lo int, n int, d1 long, d2 long, shard int"


def _by_shard(length: int):
    """Contexts in the order of their key: marks of windows that occur earlier in the shard; for split keys (parts > 1) also the
    first window of each run with its digest and the shard's number, to be merged with other shards."""

    def out(doc, lo, n, d1=None, d2=None, shard=None):
        none = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), none if d1 is None else pa.array(d1), none if d2 is None else pa.array(d2), pa.nulls(len(doc), pa.int32()) if shard is None else pa.array(shard.astype(np.int32))], names=["doc_id", "lo", "n", "d1", "d2", "shard"])

    def solve(kh, parts, salt, doc, lo, n, texts):
        text = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        context = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(context)) - first[context]
        starts = begin[context] + t
        order, group = suffix_array(text, length, starts)
        common = common_prefixes(text, first, n, order, group, starts, length)
        run = np.cumsum(common < length) - 1
        _, rank = np.unique(doc, return_inverse=True)
        place = (rank[context[order]] << 40) | (lo[context[order]] + t[order])
        heads = np.flatnonzero(common < length)
        least = np.minimum.reduceat(place, heads) if len(heads) else place
        late = order[place != least[run]]
        d, a, m = _merged(doc[context[late]], lo[context[late]] + t[late], np.ones(len(late), np.int64))
        if len(d):
            yield out(d, a, m)
        split = order[(place == least[run]) & (parts[context[order]] > 1)]
        if len(split):
            view = memoryview(text)
            digests = b"".join(xxhash.xxh3_128_digest(view[s : s + length]) for s in starts[split].tolist())
            d = np.frombuffer(digests, np.int64).reshape(-1, 2)
            yield out(doc[context[split]], lo[context[split]] + t[split], np.ones(len(split), np.int64), d[:, 0].copy(), d[:, 1].copy(), salt[context[split]])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() if c == "context" else batch.column(c).to_numpy(zero_copy_only=False) for c in ("kh", "parts", "salt", "doc_id", "lo", "n", "context")]
            for k in range(batch.num_rows):
                if size > SORT_BYTES and (cols[0][k], cols[2][k]) != last:
                    yield from solve(*_columns(held))
                    held, size = [], 0
                held.append(tuple(c[k] for c in cols))
                size += len(cols[6][k])
                last = cols[0][k], cols[2][k]
        if held:
            yield from solve(*_columns(held))

    return run


def _columns(held):
    kh, parts, salt, doc, lo, n, text = zip(*held, strict=True)
    return (*(np.array(x, np.int64) for x in (kh, parts, salt, doc, lo, n)), text)


def _merge_shards(batches):
    """Marks pass; rows with digests are in the order of slice and shard: of each slice, the sorted run tables of the shards are merged one after another by
    binary search, and all but the first of equal runs are marked. One slice is held at a time."""
    kind = np.dtype([("a", np.int64), ("b", np.int64), ("doc", np.int64), ("lo", np.int64)])

    def solve(rows: list[tuple]):
        shard, a, b, doc, lo = (np.concatenate(x) for x in zip(*rows, strict=True))
        late: list[np.ndarray] = []

        def firsts(at: np.ndarray) -> np.ndarray:
            t = np.empty(len(at), kind)
            for name, c in zip(kind.names, (a, b, doc, lo), strict=True):
                t[name] = c[at]
            t = t[np.lexsort((t["lo"], t["doc"], t["b"], t["a"]))]
            again = np.zeros(len(t), bool)
            again[1:] = (t["a"][1:] == t["a"][:-1]) & (t["b"][1:] == t["b"][:-1])
            late.append(t[again])
            return t[~again]

        bounds = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        tables = [firsts(np.arange(x, y)) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        while len(tables) > 1:
            tables.sort(key=len)
            x, y = tables.pop(0), tables.pop(0)
            at = np.searchsorted(y["a"], x["a"])
            end = np.append(y, y[-1:])
            while (less := (at < len(y)) & (end["a"][at] == x["a"]) & (end["b"][at] < x["b"])).any():
                at[less] += 1
            met = (at < len(y)) & (end["a"][at] == x["a"]) & (end["b"][at] == x["b"])
            mine, theirs = x[met], at[met]
            wins = (mine["doc"] < y["doc"][theirs]) | (mine["doc"] == y["doc"][theirs]) & (mine["lo"] < y["lo"][theirs])
            late += [y[theirs[wins]], mine[~wins]]
            y[theirs[wins]] = mine[wins]
            tables.append(np.insert(y, at[~met], x[~met]))
        gone = np.concatenate(late)
        d, a, m = _merged(gone["doc"].copy(), gone["lo"].copy(), np.ones(len(gone), np.int64))
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array(m.astype(np.int32))], names=["doc_id", "lo", "n"])

    held, last = [], None
    for b in batches:
        split = b.column("d1").is_valid().to_numpy(zero_copy_only=False)
        marks = b.filter(pa.array(~split))
        if marks.num_rows:
            yield marks.select(["doc_id", "lo", "n"])
        if not split.any():
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False)[split].astype(np.int64) for c in ("slice", "shard", "d1", "d2", "doc_id", "lo")]
        cuts = np.append(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])), len(cols[0]))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if cols[0][x] != last and held:
                yield from solve(held)
                held = []
            held.append(tuple(c[x:y] for c in cols[1:]))
            last = cols[0][x]
    if held:
        yield from solve(held)


def _cut_contexts(length: int):
    def run(batches):
        for b in batches:
            data, offsets = flat(b.column("text"))
            cols: list[list] = [[], [], [], [], [], []]
            for k, (doc, ranges) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("ranges").to_pylist(), strict=True)):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                for r in ranges:
                    for c, v in zip(cols, (r["kh"], r["parts"], doc, r["lo"], r["n"], text[r["lo"] : r["lo"] + r["n"] - 1 + length]), strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kh", "parts", "doc_id", "lo", "n", "context"])

    return run


def _cut(length: int):
    def run(batches):
        for b in batches:
            data, offsets = flat(b.column("text"))
            los, ns = b.column("los").to_pylist(), b.column("ns").to_pylist()
            removed, spans, digests, texts = [], [], [], []
            for k in range(b.num_rows):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                kept, at, gone, runs = [], 0, 0, 0
                for lo, end in sorted((x, x + y - 1 + length) for x, y in zip(los[k] or (), ns[k] or (), strict=True)):
                    if lo > at or not runs:
                        kept.append(text[at:lo])
                        runs, gone, at = runs + 1, gone + end - lo, end
                    elif end > at:
                        gone, at = gone + end - at, end
                kept.append(text[at:])
                rest = b"".join(kept)
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Removes each byte of the UTF-8 text that is covered by a string of `length` bytes that also starts earlier, in a smaller id or in the
    same document. kept_text is the rest as text, without the torn halves of characters that a cut leaves. Null and empty
    texts: 0 bytes, nothing removed. Texts shorter than length stay whole. Rows whose id is null or repeats count as documents of
    their own, ordered by (id, nulls last, text); of repeated rows the first stays. Other columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    rows, names = unique_ids(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    n = partitions(spark)
    anchors = rows.mapInArrow(trimmed(_anchor_rows(length, gram)), _ANCHORS)
    counted = rows.sample(SAMPLE, 1).mapInArrow(trimmed(_anchor_rows(length, gram)), _ANCHORS).where("not settled").groupBy("kh").agg(F.count("*").alias("c"))
    hot = table(counted.where(F.col("c") >= SHARD_CONTEXTS * SAMPLE).orderBy(F.desc("c"), "kh").limit(HOT).select(F.col("kh").alias("hot_kh")))
    anchors = anchors.join(F.broadcast(hot), F.col("kh") == F.col("hot_kh"), "left").select("kh", "ch", "doc_id", "lo", "n", "settled", F.col("hot_kh").isNotNull().alias("hot"))  # HOT rows at most

    def settled(anchors: DataFrame) -> DataFrame:
        dealt = anchors.repartition(n, "kh", F.when(F.col("hot"), F.col("ch")).otherwise(0))
        return table(dealt.sortWithinPartitions("kh", "ch", "doc_id", "lo").mapInArrow(trimmed(_by_anchor), _RANGES))

    dealt = rows.repartition(n, "doc_id")

    def with_ranges(edges: DataFrame) -> DataFrame:
        edges = edges.groupBy("doc_id").agg(F.collect_list(F.struct("kh", "parts", "lo", "n")).alias("ranges"))
        return dealt.join(edges.hint("shuffle_hash"), "doc_id")

    ranges = settled(anchors)
    large = with_ranges(ranges.where("parts > 1 or parts = -1")).mapInArrow(trimmed(_extended(length, gram, INTERVAL)), _ANCHORS).withColumn("hot", F.lit(True))
    split = settled(large)
    kinds = split.where("parts = -1").groupBy(F.col("kh").alias("key")).agg(F.count("*").alias("kinds")).where("kinds > 1")
    parts = F.ceil(F.col("kinds") / SHARD_CONTEXTS).cast("int").alias("parts")
    edges = split.where("parts = -1").join(kinds, F.col("kh") == F.col("key")).select("doc_id", "lo", "n", "kh", parts).union(ranges.where("parts = 1"))
    shards = (
        with_ranges(edges)
        .mapInArrow(trimmed(_cut_contexts(length)), "kh long, parts int, doc_id long, lo int, n int, context binary")
        .withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id, lo), parts) as int)"))
        .repartition(n, "kh", "salt")
        .sortWithinPartitions("kh", "salt")
    )
    runs = shards.mapInArrow(trimmed(_by_shard(length)), _MARKS).withColumn("slice", F.shiftright("d1", 56).cast("int"))
    marks = runs.repartition(n, F.coalesce("d1", "doc_id"), F.col("d2")).sortWithinPartitions("slice", "shard").mapInArrow(trimmed(_merge_shards), "doc_id long, lo int, n int")
    marks = marks.union(split.where("parts = 0").select("doc_id", "lo", "n"))
    marks = marks.union(ranges.where("parts = 0").select("doc_id", "lo", "n")).groupBy("doc_id").agg(F.collect_list("lo").alias("los"), F.collect_list("n").alias("ns"))
    result = dealt.join(marks.hint("shuffle_hash"), "doc_id", "left").mapInArrow(trimmed(_cut(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return old_ids(result, names, ["doc_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS p, h FROM d WHERE length(h) >= 200),
k AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 200)) AS s FROM w),
late AS (SELECT doc_id, p FROM k QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
new AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS n FROM late),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM new) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM runs),
cut AS (SELECT g.doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substring(any_value(h), 2 * max(e) + 1) AS kept FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
