"""Tokenizers (the tokenizers library, from a JSON description), in Arrow-batched functions; special tokens and padding as Columns."""

from __future__ import annotations

import itertools
import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import Operator


#: Pieces that a Python worker remembers of a tokenizer, and at most four times as many tokens.
_KNOWN = 1 << 19
#: Tokens gathered before a function hands rows on: its memory follows these and the longest row, not the batch.
_HELD = 1 << 18
#: Characters of the texts that are encoded together; a longer text is by itself.
_TAKEN = 1 << 20


@lru_cache(maxsize=16)
def _built(text: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


@lru_cache(maxsize=4)
def _plain(text: str, max_length: int | None = None):
    """Without padding, and cut to max_length only. It stays with the Python worker, as all that is cached here: the next task needn't build it."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_padding()
    t.no_truncation()
    if max_length is not None:
        t.enable_truncation(max_length)
    return t


@dataclass(frozen=True)
class TokenizerSpec:
    """A tokenizer's JSON, the ids of its special tokens (empty: it has none) and the longest input of its model (None: not known)."""

    json: str = field(repr=False)
    bos: tuple[int, ...] = ()
    sep: tuple[int, ...] = ()
    eos: tuple[int, ...] = ()
    pad_id: int = 0
    pad_type_id: int = 0
    max_length: int | None = None

    @classmethod
    def from_file(cls, path: str, **more: Any) -> TokenizerSpec:
        with open(path, encoding="utf-8") as f:
            return cls.from_tokenizer_json(f.read(), **more)

    @classmethod
    def from_tokenizer_json(cls, text: str, **more: Any) -> TokenizerSpec:
        """Special tokens are found by encoding a pair of texts with and without them."""
        t = _built(text)
        one, two = (t.encode(x, add_special_tokens=False).ids[:1] for x in ("a", "b"))
        ids = t.encode("a", "b").ids
        found: dict[str, Any] = {}
        if one and two and one[0] in ids and two[0] in ids:
            i = ids.index(one[0])
            j = len(ids) - 1 - ids[::-1].index(two[0])
            found = {"bos": tuple(ids[:i]), "sep": tuple(ids[i + 1 : j]), "eos": tuple(ids[j + 1 :])}
        if t.truncation:
            found["max_length"] = t.truncation["max_length"]
        if t.padding:
            found |= {"pad_id": t.padding["pad_id"], "pad_type_id": t.padding["pad_type_id"]}
        return cls(text, **(found | more))

    def encode(self, text: str) -> list[int]:
        return _built(self.json).encode(text, add_special_tokens=False).ids


#: The characters that stand for the bytes in the tokens of byte-level tokenizers.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_CHARS = {b: chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256)}
_BYTES = {c: b for b, c in _CHARS.items()}
_SHOWN_AS = np.array([ord(_CHARS[b]) for b in range(256)], np.uint32)

#: The pieces that byte-level tokenizers cut a text into. Letters and digits are Python's here; a text with a character that the library takes for another kind goes to the library.
_PIECE = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Kinds of characters, in the order of their numbers from 1; 0 has not been looked at.
_KINDS = re.compile(r"([^\W\d_])|(\d)|((?:[^\s\w]|_))|(\s)")
_SPACE, _UNLIKE = 4, 5


@dataclass(frozen=True)
class _Joined:
    """What an encoding of the library has, of pieces put together: ids, and flat offsets among those of the texts encoded with it, which are made when they are asked for."""

    ids: np.ndarray
    begin: int
    offsets_of: Callable[[], np.ndarray]

    def __len__(self):
        return len(self.ids)

    flat = property(lambda self: self.offsets_of()[2 * self.begin : 2 * (self.begin + len(self))])
    type_ids = special_tokens_mask = property(lambda self: np.zeros(len(self), np.int32))
    attention_mask = property(lambda self: np.ones(len(self), np.int32))
    overflowing = ()


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    until = np.cumsum(n)
    return np.arange(n.sum()) + np.repeat(first - until + n, n)


class _Places:
    """Where the ids and offsets of a piece are among those of all pieces that are remembered."""

    def __init__(self, of: _Pieces, older: _Places | None = None):
        self.of, self.older = of, older
        self.pieces, self.ids, self.flat, self.ends = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros((0, 2), np.int32), np.zeros(1, np.int64)

    def __len__(self):
        return len(self.pieces)

    def at(self, pieces: pa.StringArray) -> np.ndarray:
        """The places of different pieces; those that older places don't have either are encoded."""
        found, older = _found(pieces, self.pieces), self.older
        new = np.flatnonzero(found < 0)
        if older and len(new):
            place = _found(pieces.take(pa.array(new)), older.pieces)
            again, new, place = new[place >= 0], new[place < 0], place[place >= 0]
            n = older.ends[place + 1] - older.ends[place]
            take = _spans(older.ends[place], n)
            found[again] = self._added(pieces.take(pa.array(again)), n, older.ids[take], older.flat[take])
        if len(new):
            more = pieces.take(pa.array(new))
            found[new] = self._added(more, *self.of.encode(more))
        return found

    def _added(self, pieces: pa.StringArray, n: np.ndarray, ids: np.ndarray, flat: np.ndarray) -> np.ndarray:
        begin = len(self)
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.ends = np.concatenate([self.ends, np.cumsum(n) + len(self.ids)])
        self.ids, self.flat = np.concatenate([self.ids, ids]), np.concatenate([self.flat, flat])
        return np.arange(begin, len(self))


def _found(pieces: pa.StringArray, among: pa.StringArray) -> np.ndarray:
    """The place of each piece, or -1."""
    return pc.fill_null(pc.index_in(pieces, among), -1).to_numpy().astype(np.int64)


def _starts(codes: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of texts, one after another, start: what _PIECE finds, for all characters at once. begins: where texts that aren't empty start."""
    n = len(codes)
    first, space = np.zeros(n + 3, bool), kinds == _SPACE
    first[begins] = first[n:] = True
    start = np.ones(n + 3, bool)
    start[1:n] = (kinds[1:] != kinds[:-1]) & (space[1:] | (codes[:-1] != ord(" ")))  # a space goes with what follows it
    start[1 : n - 1] |= space[:-2] & space[1:-1] & ~space[2:] & ~first[2:n]  # the last of several spaces is apart, but not at the end of a text
    start |= first
    quotes = np.flatnonzero(start[:n] & (codes == ord("'")))
    one, two = (np.append(codes, [0, 0, 0])[quotes + k] for k in (1, 2))
    short = ~first[quotes + 1] & np.isin(one, [*map(ord, "stmd")])
    long = ~first[quotes + 1] & ~first[quotes + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    start[quotes[short | long] + 1] = False
    start[quotes[short] + 2] = start[quotes[long] + 3] = True
    return np.flatnonzero(start[:n])


class _Pieces:
    """Texts encoded by their pieces, each of which is encoded once while it is remembered: a byte-level pair encoding never looks beyond a piece."""

    def __init__(self, t):
        self.t, self.added = t, [x.content for x in t.get_added_tokens_decoder().values()]
        self.kinds = np.zeros(sys.maxunicode + 1, np.uint8)
        vocabulary = t.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int32)
        self.sizes[[*vocabulary.values()]] = [*map(len, vocabulary)]
        self.places = _Places(self)

    @staticmethod
    def fit(description: str) -> bool:
        d = json.loads(description)
        model, cut = d["model"], d["pre_tokenizer"] or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        return plain and all(c in model["vocab"] for c in _BYTES) and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and d["normalizer"] is None and d["post_processor"] is None

    def _kind(self, c: str) -> int:
        probe = f"a{c}1{c}!{c} {c}"
        alike = [probe[a:b] for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(probe)] == _PIECE.findall(probe)
        return _KINDS.fullmatch(c).lastindex if alike else _UNLIKE

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kinds[codes]
        if not kinds.all():
            for k in np.unique(codes[kinds == 0]).tolist():
                self.kinds[k] = self._kind(chr(k))
            kinds = self.kinds[codes]
        return kinds

    def encode(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of tokens of each piece, and the ids and offsets of all; a token that holds a part of a character has the whole character's place."""
        _, ends, data = pieces.buffers()
        cuts = np.frombuffer(ends, np.int32)[pieces.offset :][: len(pieces) + 1]
        data = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]
        cuts = cuts - cuts[0]
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        shown, tokenize = _SHOWN_AS[data].tobytes().decode("utf-32-le"), self.t.model.tokenize
        tokens = [[x.id for x in tokenize(shown[a:b])] for a, b in itertools.pairwise(cuts.tolist())]
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.fromiter(itertools.chain.from_iterable(tokens), np.int32, n.sum())
        until = np.cumsum(self.sizes[ids])
        flat = np.stack([char[until - self.sizes[ids]], char[until - 1] + 1], 1) - np.repeat(char[cuts[:-1]], n)[:, None]
        return n, ids, flat.astype(np.int32)

    def __call__(self, text: str) -> _Joined | None:
        return self.together([text])[0]

    def together(self, texts: list[str]) -> list[_Joined | None]:
        """None: the library has to encode this text."""
        fit = [not any(x in text for x in self.added) for text in texts]
        whole = "".join(itertools.compress(texts, fit))
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kinds = self._kinds(codes)
        if _UNLIKE in kinds:
            ends = np.cumsum([len(text) if ok else 0 for text, ok in zip(texts, fit, strict=True)])
            unlike = {*np.searchsorted(ends, np.flatnonzero(kinds == _UNLIKE), "right").tolist()}
            made = iter(self.together([text for k, text in enumerate(texts) if fit[k] and k not in unlike]))
            return [next(made) if ok and k not in unlike else None for k, ok in enumerate(fit)]
        rows = np.cumsum([0, *(len(text) for text in itertools.compress(texts, fit))])
        if not len(codes):
            return [_Joined(np.zeros(0, np.int32), 0, lambda: np.zeros(0, np.int32)) if ok else None for ok in fit]
        starts = _starts(codes, kinds, rows[:-1][np.diff(rows) > 0])
        data = np.frombuffer(whole.encode(), np.uint8)
        at = np.append(starts if len(data) == len(codes) else np.flatnonzero((data & 0xC0) != 0x80)[starts], len(data))
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        places = self.places
        if len(places) > _KNOWN // 2 or len(places.ids) > 2 * _KNOWN:  # those that come again move on, the others go with the next change
            places.older = None
            self.places = places = _Places(self, places)
        place = places.at(pieces.dictionary)
        which, first = pieces.indices.to_numpy(), places.ends[place]
        n = (places.ends[place + 1] - first)[which]
        take = _spans(first[which], n)

        @cache
        def offsets() -> np.ndarray:
            flat = places.flat[take]
            flat += np.repeat((starts - rows[np.searchsorted(rows, starts, "right") - 1]).astype(np.int32), n)[:, None]
            return flat.reshape(-1)

        ids = places.ids[take]
        tokens = np.append(0, np.cumsum(n))[np.searchsorted(starts, rows)].tolist()
        made = (_Joined(ids[a:b], a, offsets) for a, b in itertools.pairwise(tokens))
        return [next(made) if ok else None for ok in fit]


@lru_cache(maxsize=2)
def _remembered(description: str) -> _Pieces | None:
    """The pieces that tasks of a Python worker hand on to the next."""
    return _Pieces(_plain(description)) if _Pieces.fit(description) else None


def _encoder(t, description: str, by_pieces: bool, **how: Any) -> Callable[[list[str]], Iterator[Any]]:
    """Encodes texts: together, by their pieces, if the tokenizer and the caller allow it, or else by the library, one after another."""
    joined = _remembered(description) if by_pieces else None
    if joined is None:
        return lambda texts: (t.encode(text, **how) for text in texts)
    return lambda texts: (t.encode(text, **how) if made is None else made for text, made in zip(texts, joined.together(texts), strict=True))


def _characters(value: Any) -> int:
    return 0 if value is None else len(value) if isinstance(value, str) else sum(map(_characters, value))


def _taken(columns: Iterable[pa.Array]) -> Iterator[list[tuple]]:
    """The rows of a batch, by _TAKEN characters."""
    part, size = [], 0
    for row in zip(*columns, strict=True):
        part.append(tuple(x.as_py() for x in row))
        size += _characters(part[-1])
        if size >= _TAKEN:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(parts: list, values) -> pa.ListArray:
    """Lists of the lengths of the parts over values, their concatenation."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([0 if x is None else len(x) for x in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in parts], pa.bool_()))


def _flat(parts: list[np.ndarray | None]) -> np.ndarray:
    return np.concatenate([*(x for x in parts if x is not None), np.zeros(0, np.int32)])


def _integers(parts: list[np.ndarray | None]) -> pa.ListArray:
    return _lists(parts, pa.array(_flat(parts)))


def _pairs(parts: list[np.ndarray | None]) -> pa.ListArray:
    """Lists of [start, end) from flat arrays of starts and ends."""
    flat = _flat(parts)
    each = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat))
    return _lists([None if x is None else x[::2] for x in parts], each)


def _flat_offsets(e) -> np.ndarray:
    return e.flat if isinstance(e, _Joined) else np.fromiter(itertools.chain.from_iterable(e.offsets), np.int32, 2 * len(e))


def _rows(items: pa.Array, counts: list[int | None], many: bool) -> pa.Array:
    """A batch's column of sequences: counts[r] items for row r, as a list or else as the one item itself; null where it is None."""
    known = np.array([n is not None for n in counts], bool)
    if not many:
        return items.take(pa.array(np.where(known, np.cumsum(known) - 1, 0), mask=~known))
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum([n or 0 for n in counts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), items, mask=pa.array(~known))


_I, _L = T.ArrayType(T.IntegerType()), T.ArrayType(T.ArrayType(T.IntegerType()))


@dataclass(frozen=True, eq=False, repr=False)
class Tokenize(Operator):
    """A text as lists, a list of texts as lists of lists. max_length cuts; with return_overflowing_tokens the rest follows as more sequences.

    Outputs: input_ids and by flag token_type_ids, attention_mask, overflow_to_sample_mapping, special_tokens_mask, offset_mapping,
    length, word_ids, words; named with output_prefix and "_", or by output_rename_map, which must name all.
    """

    tokenizer: TokenizerSpec
    input_field: str
    output_prefix: str | None = None
    output_rename_map: dict[str, str] | None = None
    add_special_tokens: bool = True
    max_length: int | None = None
    is_split_into_words: bool = False
    return_token_type_ids: bool = False
    return_attention_mask: bool = True
    return_overflowing_tokens: bool = False
    return_special_tokens_mask: bool = False
    return_offsets_mapping: bool = False
    return_length: bool = False
    return_word_ids: bool = False
    return_words: bool = False

    def __post_init__(self):
        if self.output_rename_map is not None:
            missing = [c for c in self.plain() if c not in self.output_rename_map]
            if missing:
                raise ValueError(f"no name for {missing[0]}")

    def plain(self) -> list[str]:
        flags = {"token_type_ids": self.return_token_type_ids, "attention_mask": self.return_attention_mask, "overflow_to_sample_mapping": self.return_overflowing_tokens, "special_tokens_mask": self.return_special_tokens_mask, "offset_mapping": self.return_offsets_mapping, "length": self.return_length, "word_ids": self.return_word_ids, "words": self.return_words}
        return ["input_ids", *(k for k, v in flags.items() if v)]

    def named(self, c: str) -> str:
        if self.output_rename_map is not None:
            return self.output_rename_map[c]
        return f"{self.output_prefix}_{c}" if self.output_prefix else c

    def inputs(self):
        return (self.input_field,)

    def outputs(self, df):
        return [self.named(c) for c in self.plain()]

    def columns(self, df):
        kind = df.schema[self.input_field].dataType
        listed = A.depth(kind) > (1 if self.is_split_into_words else 0)
        many = listed or self.return_overflowing_tokens
        one = {"offset_mapping": _L, "overflow_to_sample_mapping": T.IntegerType(), "words": T.ArrayType(T.StringType())}
        plain, op = self.plain(), self
        sent = [c for c in plain if c not in ("attention_mask", "length")]  # these follow from the ids: nothing is padded
        schema = T.StructType([T.StructField(c, T.ArrayType(one.get(c, _I)) if many else one.get(c, _I)) for c in sent])

        @F.arrow_udf(schema)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            t = _plain(op.tokenizer.json, op.max_length)
            plainly = op.max_length is None and not (op.is_split_into_words or op.return_word_ids or op.return_words)
            encode = _encoder(t, op.tokenizer.json, plainly, is_pretokenized=op.is_split_into_words, add_special_tokens=op.add_special_tokens)
            for part in itertools.chain.from_iterable(_taken([column]) for column in batches):
                encoded = encode([text for (value,) in part if value is not None for text in (value if listed else [value])])
                found: dict[str, list] = {c: [] for c in sent}
                counts: list[int | None] = []
                held = 0
                for place, (value,) in enumerate(part, 1):
                    if value is None:
                        counts.append(None)
                    else:
                        texts = value if listed else [value]
                        got = []
                        for k, e in zip(range(len(texts)), encoded):  # noqa: B905  the next row's stay
                            got += [(k, x) for x in ([e, *e.overflowing] if op.return_overflowing_tokens else [e])]
                        counts.append(len(got))
                        held += sum(len(e) for _, e in got)
                        for c in sent:
                            found[c] += [_OUTPUTS[c](texts[k], k, e) for k, e in got]
                    if held >= _HELD or place == len(part):
                        yield pa.StructArray.from_arrays([_rows(_ITEMS.get(c, _integers)(found[c]), counts, many) for c in sent], names=sent)
                        found, counts, held = {c: [] for c in sent}, [], 0

        made = run(F.col(self.input_field))
        each = (lambda f: F.transform(made["input_ids"], f)) if many else lambda f: f(made["input_ids"])
        follow = {"attention_mask": lambda ids: F.transform(ids, lambda _: F.lit(1)), "length": F.size}
        return {self.named(c): each(follow[c]) if c in follow else made[c] for c in plain}

    def transform(self, df):
        made = self.columns(df)
        return df.withColumns(made)


def _words(text, e) -> list[str | None]:
    def word(k):
        if not isinstance(text, str):
            return text[k]
        span = e.word_to_chars(k)
        return text[span[0] : span[1]] if span else None

    known = {k: word(k) for k in set(e.word_ids) - {None}}
    return [known.get(k) for k in e.word_ids]


#: What a sequence (its text, its text's number in the row, its encoding) gives to each output, and how a batch's sequences become a column.
_OUTPUTS = {
    "input_ids": lambda text, k, e: np.array(e.ids, np.int32),
    "token_type_ids": lambda text, k, e: np.array(e.type_ids, np.int32),
    "special_tokens_mask": lambda text, k, e: np.array(e.special_tokens_mask, np.int32),
    "offset_mapping": lambda text, k, e: _flat_offsets(e),
    "overflow_to_sample_mapping": lambda text, k, e: k,
    "word_ids": lambda text, k, e: e.word_ids,
    "words": lambda text, k, e: _words(text, e),
}
_ITEMS = {
    "offset_mapping": _pairs,
    "overflow_to_sample_mapping": lambda x: pa.array(x, pa.int32()),
    "word_ids": lambda x: pa.array(x, pa.list_(pa.int32())),
    "words": lambda x: pa.array(x, pa.list_(pa.string())),
}


@dataclass(frozen=True, eq=False, repr=False)
class EncodeFields(Operator):
    """Ids of several text fields without special tokens, in one Python round trip; offset_<field> with the [start, end) of each token on request."""

    fields_to_encode: tuple[str, ...]
    tokenizer: TokenizerSpec
    is_split_into_words: bool = False
    fields_to_return_offset_mapping: tuple[str, ...] = ()
    offset_prefix: str = "offset"

    def inputs(self):
        return tuple(self.fields_to_encode)

    def outputs(self, df):
        return [*self.fields_to_encode, *(f"{self.offset_prefix}_{c}" for c in self.fields_to_return_offset_mapping)]

    def columns(self, df):
        op, names = self, self.outputs(df)
        base = 1 if self.is_split_into_words else 0
        nested = {c: A.depth(df.schema[c].dataType) > base for c in self.fields_to_encode}
        schema = T.StructType([T.StructField(c, T.ArrayType(_I) if nested[c] else _I) for c in self.fields_to_encode] + [T.StructField(f"{self.offset_prefix}_{c}", T.ArrayType(_L) if nested[c] else _L) for c in self.fields_to_return_offset_mapping])

        def made_of(found: dict[str, tuple[list, list, list]]) -> pa.Array:
            out: dict[str, pa.Array] = {}
            for c, (ids, offsets, counts) in found.items():
                out[c] = _rows(_integers(ids), counts, nested[c])
                if c in op.fields_to_return_offset_mapping:
                    out[f"{op.offset_prefix}_{c}"] = _rows(_pairs(offsets), counts, nested[c])
            return pa.StructArray.from_arrays([out[n] for n in names], names=names)

        @F.arrow_udf(schema)
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            t = _plain(op.tokenizer.json)
            encode = _encoder(t, op.tokenizer.json, not op.is_split_into_words, is_pretokenized=op.is_split_into_words, add_special_tokens=False)
            for part in itertools.chain.from_iterable(_taken(batch if isinstance(batch, tuple) else (batch,)) for batch in batches):
                listed = [[([] if value is None else value if nested[c] else [value]) for c, value in zip(op.fields_to_encode, row, strict=True)] for row in part]
                encoded = encode([text for row in listed for texts in row for text in texts if text is not None])
                found, held = {c: ([], [], []) for c in op.fields_to_encode}, 0
                for place, (row, values) in enumerate(zip(listed, part, strict=True), 1):
                    for c, texts, value in zip(op.fields_to_encode, row, values, strict=True):
                        ids, offsets, counts = found[c]
                        counts.append(None if value is None else len(texts))
                        for text in texts:
                            e = None if text is None else next(encoded)
                            ids.append(None if e is None else np.array(e.ids, np.int32))
                            held += 0 if e is None else len(e)
                            if c in op.fields_to_return_offset_mapping:
                                offsets.append(None if e is None else _flat_offsets(e))
                    if held >= _HELD or place == len(part):
                        yield made_of(found)
                        found, held = {c: ([], [], []) for c in op.fields_to_encode}, 0

        made = run(*[F.col(c) for c in self.fields_to_encode])
        return {n: made[n] for n in names}


@lru_cache(maxsize=4)
def _token_bytes(description: str, skip_special_tokens: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """The bytes of all tokens by id, one after another, and their ends; none for an id without a token, as the last one. None: a text isn't its tokens' bytes."""
    if (json.loads(description)["decoder"] or {}).get("type") != "ByteLevel":
        return None
    t = _built(description)
    skipped = {x.content for x in t.get_added_tokens_decoder().values() if x.special and skip_special_tokens}
    names = {k: token for token, k in t.get_vocab().items()} | {k: x.content for k, x in t.get_added_tokens_decoder().items()}
    parts = [b"" if (x := names.get(k, "")) in skipped else bytes(map(_BYTES.get, x)) if _BYTES.keys() >= set(x) else x.encode() for k in range(max(names, default=0) + 2)]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _put_together(lists: pa.ListArray, data: np.ndarray, ends: np.ndarray) -> pa.StringArray | None:
    """Texts of lists of ids from the bytes of tokens; None: a text isn't valid, or an id isn't."""
    flat = lists.flatten()
    ids = None if flat.null_count else flat.to_numpy()
    if ids is None or len(ids) and ids.min() < 0:
        return None
    at = np.minimum(ids, len(ends) - 2)
    n = ends[at + 1] - ends[at]
    until = np.cumsum(n)
    made = data[_spans(ends[at], n)]
    rows = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_numpy()])
    places = np.concatenate([[0], until])[rows].astype(np.int32)
    texts = pa.StringArray.from_buffers(len(lists), pa.py_buffer(places), pa.py_buffer(made))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return None
    return pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string())) if lists.null_count else texts


@dataclass(frozen=True, eq=False, repr=False)
class Decode(Operator):
    """Ids as text, lists of ids as lists of texts."""

    tokenizer: TokenizerSpec
    fields: tuple[str, ...]
    skip_special_tokens: bool = False
    clean_up_tokenization_spaces: bool = True

    def inputs(self):
        return tuple(self.fields)

    def outputs(self, df):
        return list(self.fields)

    def columns(self, df):
        return {c: self._decoder(A.depth(df.schema[c].dataType) > 1)(F.col(c)) for c in self.fields}

    def _decoder(self, nested: bool):
        op = self

        @F.arrow_udf("array<string>" if nested else "string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            t, known = _built(op.tokenizer.json), _token_bytes(op.tokenizer.json, op.skip_special_tokens)

            def texts(lists: pa.ListArray) -> pa.Array:
                made = known and _put_together(lists, *known)
                if made is None:
                    made = pa.array([None if x is None else t.decode(x, skip_special_tokens=op.skip_special_tokens) for x in lists.to_pylist()], pa.string())
                if op.clean_up_tokenization_spaces:
                    made = pa.array([x and re.sub(r" ([.?!,]|n't|'(?:m|s|ve|re)\b)", r"\1", x) for x in made.to_pylist()], pa.string())
                return made

            for column in batches:
                counts = pc.list_value_length(column).to_pylist()
                ends = np.cumsum([0, *(n or 0 for n in counts)])
                sizes = counts
                if nested:
                    each = np.cumsum([0, *pc.fill_null(pc.list_value_length(column.flatten()), 0).to_numpy()])
                    sizes = np.diff(each[ends])
                begin = held = 0
                for place, n in enumerate(sizes, 1):
                    held += n or 0
                    if held >= _HELD or place == len(column):
                        part = column.slice(begin, place - begin)
                        yield _rows(texts(part.flatten()), counts[begin:place], True) if nested else texts(part)
                        begin, held = place, 0

        return run


@dataclass(frozen=True, eq=False, repr=False)
class _SequencePadding(Operator):
    tokenizer: TokenizerSpec
    input_field: str = "input_ids"

    def inputs(self):
        return (self.input_field,)

    def outputs(self, df):
        return [self.input_field]

    def _marks(self, kind) -> list[Column]:
        return [F.array(*[F.lit(x) for x in ids]).cast(kind) for ids in (self.tokenizer.bos, self.tokenizer.sep, self.tokenizer.eos)]

    def _wrap(self, c, s, i, marks):
        bos, sep, eos = marks
        none = F.slice(s, 1, 0)
        return F.concat(F.when(i == 0, bos).otherwise(none), s, F.when(i == F.size(c) - 1, eos).otherwise(sep))

    def columns(self, df):
        c, kind = F.col(self.input_field), df.schema[self.input_field].dataType
        marks = self._marks(kind.elementType)
        return {self.input_field: F.transform(c, lambda s, i: self._wrap(c, s, i, marks))}


@dataclass(frozen=True, eq=False, repr=False)
class TokensSequencesPadding(_SequencePadding):
    """Special tokens around a list of sequences: before the first, after each but the last, after the last."""


@dataclass(frozen=True, eq=False, repr=False)
class AttentionMaskSequencePadding(_SequencePadding):
    """Ones where TokensSequencesPadding puts tokens."""

    input_field: str = "attention_mask"

    def _marks(self, kind):
        return [F.array(*[F.lit(1)] * len(ids)).cast(kind) for ids in (self.tokenizer.bos, self.tokenizer.sep, self.tokenizer.eos)]


@dataclass(frozen=True, eq=False, repr=False)
class TokenTypeIdsSequencePadding(_SequencePadding):
    """Each sequence's own first symbol (0 if empty) where special tokens stand; separators before all but the first."""

    input_field: str = "token_type_ids"

    def _wrap(self, c, s, i, marks):
        first = F.coalesce(F.get(s, F.lit(0)), F.lit(0))
        n = [len(x) for x in (self.tokenizer.bos, self.tokenizer.sep, self.tokenizer.eos)]
        return F.concat(F.when(i == 0, A.filled(first, F.lit(n[0]))).otherwise(A.filled(first, F.lit(n[1]))), s, F.when(i == F.size(c) - 1, A.filled(first, F.lit(n[2]))).otherwise(F.slice(s, 1, 0)))
