"""Unigram segmentation over a piece vocabulary: pre-tokens, a trie with shared forward scores, and exact N-best by A-star.

Spaces stay bytes 0x20 (the vocabulary's space mark stands for them), so decoding is the concatenation of piece bytes. A text starts with
one space that decoding drops. Pre-tokens start at the first of some spaces and before and after a line break; no piece crosses these places, so the
best segmentation of a text is that of its pre-tokens. The vocabulary files have merge ranks; the score of rank r is -log(r + 2), Zipf's
law, and a byte that no piece covers costs FALLBACK more than the last rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkernel import _U, Ranges, flat, pieces

FALLBACK = 5.0
#: Longer pre-tokens are solved one by one, not in the trie: the same sums in the same order, so the same result, in time linear in their length.
LONGEST = 64
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class PieceTable:
    """Pieces as bytes with their scores, found by hash."""

    def __init__(self, pieces: list[tuple[bytes, int, float]], bytes_: list[int], others: dict[int, bytes] | None = None):
        """pieces: (bytes, id, score); bytes_: ids of the 256 byte tokens; others: spelling of ids that no text is encoded to."""
        pieces = [p for p in pieces if p[0] and not _crosses(p[0])]
        self.scores_by_piece = {b: (i, s) for b, i, s in pieces}
        self.width = max((len(p[0]) for p in pieces), default=1)
        data = np.frombuffer(b"".join(p[0] for p in pieces), np.uint8)
        ends = np.cumsum([len(p[0]) for p in pieces]).astype(np.int64)
        h = Ranges(data).hashes(ends - [len(p[0]) for p in pieces], ends) if pieces else np.zeros(0, _U)
        o = np.argsort(h)
        self.keys, self.ids, self.scores = h[o], np.array([p[1] for p in pieces], np.int64)[o], np.array([p[2] for p in pieces], float)[o]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> _U(44)] = True
        self.bytes = np.array(bytes_, np.int64)
        self.fallback = float(self.scores.min() if len(self.scores) else 0.0) - FALLBACK
        spelling = {i: b for b, i, _ in pieces} | {i: bytes([k]) for k, i in enumerate(bytes_)} | (others or {})
        size = max(spelling) + 1
        self.known = np.zeros(size, bool)
        self.known[list(spelling)] = True
        self.sizes = np.array([len(spelling.get(i, b"")) for i in range(size)])
        self.ends = np.cumsum(self.sizes)
        self.spelled = np.frombuffer(b"".join(spelling.get(i, b"") for i in range(size)), np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in ids and scores, or -1."""
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.maybe[h >> _U(44)])
        if len(some) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            hit = self.keys[at] == h[some]
            out[some[hit]] = at[hit]
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str | None]:
        """The text of each list of ids: piece bytes joined, without the first space; bytes that are no UTF-8 are replaced. Null for a list with ids outside the vocabulary."""
        out: list[str | None] = []
        for a, b in pieces(offsets, 1 << 16):
            parts, sizes, wrong = [], [], []
            for at in range(int(offsets[a]), int(offsets[b]), 1 << 16):  # a long list in slices
                x = np.asarray(ids[at : min(at + (1 << 16), int(offsets[b]))], np.int64)
                fine = (x >= 0) & (x < len(self.known))
                x = np.where(fine, x, 0)
                fine &= self.known[x]
                size = np.where(fine, self.sizes[x], 0)
                ends = np.cumsum(size)
                parts.append(self.spelled[np.repeat(self.ends[x] - ends, size) + np.arange(int(ends[-1]))].tobytes())
                sizes.append(size)
                wrong.append(~fine)
            data = b"".join(parts)
            own = offsets[a : b + 1] - offsets[a]
            place = np.cumsum(np.concatenate([[0], *sizes]))[own].tolist()
            bad = np.diff(np.cumsum(np.concatenate([[0], *wrong]))[own]).tolist()
            out += [None if w else data[x:y].decode("utf-8", "replace")[1:] for x, y, w in zip(place[:-1], place[1:], bad, strict=True)]
        return out


def _crosses(piece: bytes) -> bool:
    body = piece.lstrip(b" ")
    return b" " in body or b"\n" in piece and len(piece) > 1


def load(path: str = DEFAULT_MODEL) -> PieceTable:
    """The pieces of a SentencePiece model file (read on the driver; the table is sent to the executors)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found, bytes_, others = [], [0] * 256, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
        elif model.is_unknown(i):
            others[i] = " \u2047 ".encode()
        elif model.is_control(i) or model.is_unused(i):
            others[i] = b""
        else:
            found.append((piece.replace("▁", " ").encode(), i, -model.get_score(i)))
    found.sort(key=lambda x: x[2])
    return PieceTable([(b, i, -float(np.log(rank + 2))) for rank, (b, i, _) in enumerate(found)], bytes_, others)


def pretokens(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Ranges]]:
    """(first row, last row, bytes, starts, ends, row of each pre-token, hashes) of slices; a text that isn't empty starts with one more space."""
    column = pc.fill_null(batch.column(name).cast(pa.large_string()), "")
    column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
    data, offsets = flat(column)
    for a, b in pieces(offsets, most):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if not len(d):
            continue
        first = np.zeros(len(d) + 1, bool)
        first[o] = True
        edge = first[:-1].copy()
        space, line = d == 32, d == 10
        edge[1:] |= space[1:] & ~space[:-1] | line[:-1] | line[1:]
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(d))
        yield a, b, d, starts, ends, np.searchsorted(o, starts, "right") - 1, Ranges(d)


class Trie:
    """Distinct pre-tokens in a trie. Each node has the two best forward scores of its prefix, computed once, and the best one's last piece and length.

    Level by level: the nodes of one depth are the distinct pairs of a node above and a byte. Words are ordered by falling length, so those
    that reach a depth come first. Ties go to the longer last piece.
    """

    def __init__(self, data: np.ndarray, ranges: Ranges, starts: np.ndarray, ends: np.ndarray, table: PieceTable):
        self.order = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[self.order], ends[self.order]
        self.length = ends - starts
        n = len(starts)
        self.nodes = [np.zeros(n, np.int64)]
        self.best, self.second, self.back, self.piece, self.count = [np.zeros(1)], [np.full(1, -np.inf)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for d in range(1, int(self.length[0]) + 1 if n else 1):
            m = int(np.searchsorted(-self.length, -d, "right"))
            byte = data[starts[:m] + d - 1]
            _, word, node = np.unique(self.nodes[d - 1][:m] * 256 + byte, return_index=True, return_inverse=True)
            at = starts[word]
            f1, f2 = np.full(len(word), -np.inf), np.full(len(word), -np.inf)
            back, piece = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
            for size in range(min(d, table.width), 0, -1):
                found = table.find(ranges.hashes(at + (d - size), at + d))
                if size == 1:
                    ids = np.where(found >= 0, table.ids[found], table.bytes[byte[word]]) if len(table.ids) else table.bytes[byte[word]]
                    score = np.where(found >= 0, table.scores[found], table.fallback) if len(table.ids) else np.full(len(word), table.fallback)
                    hit = np.arange(len(word))
                else:
                    hit = np.flatnonzero(found >= 0)
                    if not len(hit):
                        continue
                    ids, score = table.ids[found[hit]], table.scores[found[hit]]
                above = self.nodes[d - size][word[hit]]
                c1, c2 = self.best[d - size][above] + score, self.second[d - size][above] + score
                old1 = f1[hit]
                wins = c1 > old1
                f2[hit] = np.where(wins, np.maximum(old1, c2), np.maximum(f2[hit], c1))
                f1[hit] = np.where(wins, c1, old1)
                back[hit] = np.where(wins, size, back[hit])
                piece[hit] = np.where(wins, ids, piece[hit])
            above = np.empty(len(word), np.int64)
            for size in np.unique(back):
                pick = back == size
                above[pick] = self.count[d - size][self.nodes[d - size][word[pick]]] + 1
            for store, x in ((self.nodes, node), (self.best, f1), (self.second, f2), (self.back, back), (self.piece, piece), (self.count, above)):
                store.append(x)

    def terminals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of the best segmentation, its score, distance to the second best) of each word, as they were given."""
        n = len(self.length)
        count, best, gap = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for d in np.unique(self.length):
            w = np.flatnonzero(self.length == d)
            k = self.nodes[d][w]
            to = self.order[w]
            count[to], best[to], gap[to] = self.count[d][k], self.best[d][k], self.best[d][k] - self.second[d][k]
        return count, best, gap

    def segmentations(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the best segmentation of each word, as they were given."""
        n = len(self.length)
        count = self.terminals()[0]
        offsets = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(int(offsets[-1]), np.int64)
        at, slot, word = self.length.copy(), offsets[self.order + 1] - 1, np.arange(n)
        while len(word):
            for d in np.unique(at):
                w = np.flatnonzero(at == d)
                k = self.nodes[d][word[w]]
                ids[slot[w]] = self.piece[d][k]
                at[w] -= self.back[d][k]
            slot -= 1
            go = at > 0
            at, slot, word = at[go], slot[go], word[go]
        return ids, offsets


class Lattice:
    """The pieces that end at each place of one pre-token, longer ones first, and the best forward scores, by the trie's sums. Time and memory are linear in its length."""

    def __init__(self, word: bytes, table: PieceTable):
        n = self.size = len(word)
        (self._look_up if n <= LONGEST else self._join)(word, table)
        forward, back = [0.0] * (n + 1), [0] * (n + 1)
        at, start, score = self.at, self.start, self.scores
        for e in range(1, n + 1):
            most, which = -np.inf, 0
            for k in range(at[e], at[e + 1]):
                x = forward[start[k]] + score[k]
                if x > most:
                    most, which = x, k
            forward[e], back[e] = most, which
        self.forward, self.back = forward, back

    def _look_up(self, word: bytes, table: PieceTable) -> None:
        """The pieces of a short word, one by one."""
        self.at, self.start, self.ids, self.scores = [0, 0], [], [], []
        get, width = table.scores_by_piece.get, table.width
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - width), e):
                hit = get(word[s:e])
                if hit is None:
                    if s < e - 1:
                        continue
                    hit = int(table.bytes[word[s]]), table.fallback
                self.start.append(s)
                self.ids.append(hit[0])
                self.scores.append(hit[1])
            self.at.append(len(self.ids))

    def _join(self, word: bytes, table: PieceTable) -> None:
        """The pieces of a long word, all places of a length at once."""
        n = len(word)
        data = np.frombuffer(word, np.uint8)
        ranges = Ranges(data)
        ends, sizes, ids, scores = [], [], [], []
        for size in range(min(n, table.width), 0, -1):
            end = np.arange(size, n + 1)
            found = table.find(ranges.hashes(end - size, end))
            if size == 1:
                hit = np.arange(len(end))
                some = found >= 0
                own = np.where(some, table.ids[found], table.bytes[data]) if len(table.ids) else table.bytes[data]
                score = np.where(some, table.scores[found], table.fallback) if len(table.ids) else np.full(n, table.fallback)
            else:
                hit = np.flatnonzero(found >= 0)
                own, score = table.ids[found[hit]], table.scores[found[hit]]
            ends.append(end[hit])
            sizes.append(np.full(len(hit), size))
            ids.append(own)
            scores.append(score)
        end, size = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in (ends, sizes))
        o = np.argsort(end, kind="stable")
        self.at = np.searchsorted(end[o], np.arange(n + 2)).tolist()
        self.start = (end - size)[o].tolist()
        self.ids, self.scores = (np.concatenate(x)[o].tolist() if n else [] for x in (ids, scores))

    def best(self) -> list[int]:
        """Ids of the best segmentation; ties go to the longer last piece."""
        out, e = [], self.size
        while e:
            out.append(self.ids[self.back[e]])
            e = self.start[self.back[e]]
        return out[::-1]


def nbest(word: bytes, table: PieceTable, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a pre-token, best first: (score, ids).

    Forward Viterbi scores of the prefixes are the exact cost of what a backward search has still to cover, so A-star from the end pops
    complete segmentations in falling order. The frontier holds the best open piece of each partial path: a popped one opens the next best piece beside it and the
    best piece before it. No place is entered more than n times, so there are n times its length entries at most. Ties (to 1e-9): what was opened last, the longer piece first.
    """
    lattice = Lattice(word, table)
    at, start, ids, scores, forward = lattice.at, lattice.start, lattice.ids, lattice.scores, lattice.forward
    ranked: dict[int, list[int]] = {}
    heap: list[tuple] = []
    nodes: list[tuple[int, int]] = [(-1, -1)]  # piece, node after it
    entered: dict[int, int] = {}
    out = [(forward[-1], lattice.best())]  # so that ties for the first place are broken as in the trie

    def push(e: int, rank: int, done: float, node: int) -> None:
        if e not in ranked:
            ranked[e] = sorted(range(at[e], at[e + 1]), key=lambda k: -round(forward[start[k]] + scores[k], 9))
        if rank < len(ranked[e]):
            k = ranked[e][rank]
            heapq.heappush(heap, (-round(forward[start[k]] + scores[k] + done, 9), -len(nodes), rank, e, done, node))

    if not word:
        return out
    push(lattice.size, 0, 0.0, 0)
    while heap and len(out) < n:
        _, _, rank, e, done, node = heapq.heappop(heap)
        k = ranked[e][rank]
        s = start[k]
        push(e, rank + 1, done, node)
        entered[s] = entered.get(s, 0) + 1
        if entered[s] > n:
            continue
        nodes.append((k, node))
        if s:
            push(s, 0, done + scores[k], len(nodes) - 1)
            continue
        path, x = [], len(nodes) - 1
        while x:
            path.append(nodes[x][0])
            x = nodes[x][1]
        found = [ids[k] for k in path]
        if found != out[0][1]:
            out.append((sum((scores[k] for k in path), 0.0), found))
    return out
