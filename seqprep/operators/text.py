"""Words, repair, truncation and joining of texts."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import FieldError, Operator
from .tokenize import TokenizerSpec

#: Patterns of the splitters.
SPLITTERS = {"ws": r"(?U)\S+", "plus": r"(?U)\w+|[^\w\s]+", "trail": r"(?U)(?:\w+|[^\w\s]+)\s*", "blingfire": r"(?U)\w+|[^\w\s]+"}


@dataclass(frozen=True, eq=False, repr=False)
class TextToWords(Operator):
    """A text as a list of words, a list of texts as a list of lists. ws: at white space; plus: punctuation apart; trail: with the space after."""

    fields: tuple[str, ...]
    splitter: str = "plus"

    def __post_init__(self):
        if self.splitter not in SPLITTERS:
            raise ValueError(f"splitter is one of {', '.join(SPLITTERS)}")

    def inputs(self):
        return tuple(self.fields)

    def columns(self, df):
        return {c: A.leaves(F.col(c), df.schema[c].dataType, lambda x, _: F.regexp_extract_all(x, F.lit(SPLITTERS[self.splitter]), F.lit(0))) for c in self.fields}

    def outputs(self, df):
        return list(self.fields)


@dataclass(frozen=True, eq=False, repr=False)
class WordsToText(Operator):
    """Words joined; of a list of lists each."""

    fields: tuple[str, ...]
    joiner: str = " "

    def inputs(self):
        return tuple(self.fields)

    def columns(self, df):
        def join(c, kind):
            if isinstance(kind.elementType, T.ArrayType):
                return F.transform(c, lambda x: join(x, kind.elementType))
            return F.array_join(c, self.joiner)

        return {c: join(F.col(c), df.schema[c].dataType) for c in self.fields}

    def outputs(self, df):
        return list(self.fields)


_LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "ſt", 0xFB06: "st"}
_QUOTES = {0x2018: "'", 0x2019: "'", 0x201A: "'", 0x201B: "'", 0x201C: '"', 0x201D: '"', 0x201E: '"', 0x201F: '"'}
_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0x3000: " "}
_CONTROLS = {c: None for c in [*range(0, 9), 11, *range(14, 32), 127, *range(0x206A, 0x2070), 0xFEFF]}
_BROKEN = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]")
_OPTIONS = frozenset("unescape_html fix_encoding uncurl_quotes fix_latin_ligatures fix_character_width fix_line_breaks remove_control_chars normalization".split())


def _single_bytes(text: str) -> bytes:
    """The bytes whose reading as Windows-1252 (undefined ones as Latin-1) gave text; raises if there are none."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            out += c.encode("latin-1")
    return bytes(out)


def repair(text: str, **options) -> str:
    """Undo wrong decodings and entities, and make quotes, ligatures, widths, line breaks and controls plain."""
    on = lambda name: options.get(name, True)
    if on("unescape_html") and "<" not in text:
        text = re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: (lambda u: u if u != m[0] else html.unescape(m[0].lower()).upper() if m[0].isupper() or m[0][1:-1].isupper() else u)(html.unescape(m[0])), text)
    if on("fix_encoding") and _BROKEN.search(text):
        text = re.sub(r"\bÃ (?=\w)", "à ", text)  # its no-break space has become a plain one
    while on("fix_encoding") and _BROKEN.search(text):
        try:
            better = _single_bytes(text).decode("utf-8")
        except UnicodeError:
            better = re.sub(r"[Â-ô][\u0080-¿Œ-™]{1,3}", _piece, text)
        if better == text:
            break
        text = better
    for name, table in (("fix_latin_ligatures", _LIGATURES), ("fix_character_width", _WIDE), ("uncurl_quotes", _QUOTES)):
        if on(name):
            text = text.translate(table)
    if on("fix_line_breaks"):
        text = re.sub("\r\n|[\r\u2028\u2029\u0085]", "\n", text)
    if on("remove_control_chars"):
        text = text.translate(_CONTROLS)
    form = options.get("normalization", "NFC")
    return unicodedata.normalize(form, text) if form else text


def _piece(m: re.Match) -> str:
    for n in range(len(m[0]), 1, -1):
        try:
            return _single_bytes(m[0][:n]).decode("utf-8") + m[0][n:]
        except UnicodeError:
            continue
    return m[0]


@dataclass(frozen=True, eq=False, repr=False)
class FixText(Operator):
    """repair() of text fields, in Arrow batches."""

    input_fields: tuple[str, ...]
    options: tuple[tuple[str, object], ...] = ()

    def __post_init__(self):
        unknown = [k for k, _ in self.options if k not in _OPTIONS]
        if unknown:
            raise ValueError(f"unknown option {unknown[0]}")

    def inputs(self):
        return tuple(self.input_fields)

    def columns(self, df):
        options = dict(self.options)

        @F.pandas_udf("string")
        def fix(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else repair(x, **options))

        return {c: fix(F.col(c)) for c in self.input_fields}

    def outputs(self, df):
        return list(self.input_fields)


@dataclass(frozen=True, eq=False, repr=False)
class ValidUnicode(Operator):
    """Tokens made only of characters of the given Unicode categories (empty ones too) replaced."""

    input_fields: tuple[str, ...]
    unicode_categories: tuple[str, ...]
    replace_token: str

    def inputs(self):
        return tuple(self.input_fields)

    def columns(self, df):
        pattern = "^[" + "".join(f"\\p{{{c}}}" for c in self.unicode_categories) + "]*\\z"
        return {c: A.leaves(F.col(c), df.schema[c].dataType, lambda x, _: F.when(x.rlike(pattern), F.lit(self.replace_token)).otherwise(x)) for c in self.input_fields}

    def outputs(self, df):
        return list(self.input_fields)


@dataclass(frozen=True, eq=False, repr=False)
class TruncateSingleField(Operator):
    """The first n symbols of lists or texts; a negative n drops from the end."""

    fields_to_truncate: dict[str, int]

    def inputs(self):
        return tuple(self.fields_to_truncate)

    def columns(self, df):
        return {c: A.head(F.col(c), df.schema[c].dataType, F.lit(n)) for c, n in self.fields_to_truncate.items()}

    def outputs(self, df):
        return list(self.fields_to_truncate)


def uniform(lengths: list[Column], budget: Column) -> list[Column]:
    """Lengths cut in proportion to fit the budget."""
    total = sum(lengths[1:], lengths[0])
    ratio = budget.cast("double") / F.nullif(total, F.lit(0))
    return [F.when((total == 0) | (ratio >= 1), n).otherwise(F.floor(n * F.greatest(ratio, F.lit(0.0)))).cast("int") for n in lengths]


def longest(lengths: list[Column], budget: Column) -> list[Column]:
    """Lengths up to an even share kept, what they leave dealt to the longer ones in proportion to their excess."""
    total = sum(lengths[1:], lengths[0])
    share = F.floor(F.greatest(budget, F.lit(0)) / len(lengths))
    excess = [F.greatest(n - share, F.lit(0)) for n in lengths]
    spare = [F.greatest(share - n, F.lit(0)) for n in lengths]
    rest = F.greatest(budget, F.lit(0)) - share * len(lengths) + sum(spare[1:], spare[0])
    more = uniform(excess, rest)
    return [F.when(total <= budget, n).otherwise(F.when(n > share, share + e).otherwise(n)).cast("int") for n, e in zip(lengths, more, strict=True)]


@dataclass(frozen=True, eq=False, repr=False)
class TruncateMultipleFields(Operator):
    """Cut several texts or lists so that together with the preserved ones they fit max_length - length_penalty; max_length may come from a tokenizer."""

    fields_to_truncate: tuple[str, ...]
    max_length: int | None = None
    fields_to_preserve: tuple[str, ...] = ()
    length_penalty: int = 0
    strategy: str = "longest"
    tokenizer: TokenizerSpec | None = None

    def __post_init__(self):
        if self._most() is None:
            raise ValueError("give max_length, or a tokenizer that has one")
        if self.strategy not in ("longest", "uniform"):
            raise ValueError("strategy is longest or uniform")

    def _most(self):
        return self.max_length if self.max_length is not None else self.tokenizer and self.tokenizer.max_length

    def inputs(self):
        return (*self.fields_to_truncate, *self.fields_to_preserve)

    def _flat(self, df, c):
        return F.col(c), df.schema[c].dataType

    def columns(self, df):
        kinds = {c: self._flat(df, c) for c in self.inputs()}
        names = sorted(self.fields_to_truncate)
        size = {c: A.size_of(*k) for c, k in kinds.items()}
        budget = F.lit(self._most() - self.length_penalty)
        for c in self.fields_to_preserve:
            budget = budget - size[c]
        fit = (longest if self.strategy == "longest" else uniform)([size[c] for c in names], budget)
        return {c: self._cut(df, c, n) for c, n in zip(names, fit, strict=True)}

    def _cut(self, df, c, n):
        return A.head(F.col(c), df.schema[c].dataType, n)

    def outputs(self, df):
        return list(self.inputs())


@dataclass(frozen=True, eq=False, repr=False)
class TruncateMultipleNestedFields(TruncateMultipleFields):
    """As TruncateMultipleFields on lists of lists: lengths count all symbols, cuts fall on the last lists first."""

    def _flat(self, df, c):
        return A.flat(F.col(c), df.schema[c].dataType)

    def _cut(self, df, c, n):
        if A.depth(df.schema[c].dataType) < 2:
            return super()._cut(df, c, n)
        state = lambda i, left, at: F.struct(i.cast("int").alias("i"), left.cast("long").alias("left"), at.cast("int").alias("at"))

        def step(a, x):
            goes_on = F.when(a["left"] >= F.size(x), state(a["i"] + 1, a["left"] - F.size(x), a["at"])).otherwise(state(a["i"] + 1, a["left"], a["i"]))
            return F.when(a["at"].isNull(), goes_on).otherwise(a)

        def cut(a):
            part = lambda x: F.slice(x, 1, F.least(F.greatest(a["left"], F.lit(0)).cast("int"), F.size(x)))
            return F.transform(F.col(c), lambda x, i: F.when(a["at"].isNull() | (i < a["at"]), x).when(i == a["at"], part(x)).otherwise(F.slice(x, 1, 0)))

        return F.aggregate(F.col(c), state(F.lit(0), n, F.lit(None)), step, cut)  # one fold finds the list that the cut falls into


@dataclass(frozen=True, eq=False, repr=False)
class ConcatenateContext(Operator):
    """A text stays; a list of sections is wrapped and joined; of a list of lists the first item of each is a header, the rest are paragraphs."""

    context_field_name: str = "context"
    section_bos: str = ""
    section_eos: str = "\n"
    paragraph_bos: str = "\n\n"
    paragraph_eos: str = "\n"
    header_bos: str | None = None
    header_eos: str | None = None
    document_bos: str = ""
    document_eos: str = ""

    def inputs(self):
        return (self.context_field_name,)

    def columns(self, df):
        c, kind = F.col(self.context_field_name), df.schema[self.context_field_name].dataType
        wrap = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
        if isinstance(kind, T.StringType):
            return {self.context_field_name: c}
        if A.depth(kind) == 1:
            joined = F.array_join(F.transform(F.filter(c, lambda s: s.isNotNull()), lambda s: wrap(self.section_bos, s, self.section_eos)), "")
        elif A.depth(kind) == 2:
            hb = self.paragraph_bos if self.header_bos is None else self.header_bos
            he = self.paragraph_eos if self.header_eos is None else self.header_eos
            inner = lambda s: F.array_join(F.transform(s, lambda p, i: F.when(i == 0, wrap(hb, p, he)).otherwise(wrap(self.paragraph_bos, p, self.paragraph_eos))), "")  # noqa: E731  array_join skips nulls
            joined = F.array_join(F.transform(F.filter(c, lambda s: s.isNotNull()), lambda s: wrap(self.section_bos, inner(s), self.section_eos)), "")
        else:
            raise FieldError("context is a text, a list or a list of lists")
        return {self.context_field_name: wrap(self.document_bos, joined, self.document_eos)}

    def outputs(self, df):
        return [self.context_field_name]


@dataclass(frozen=True, eq=False, repr=False)
class AddEvidencesLocation(Operator):
    """[start, end) of each evidence in the context, [-1, -1] where it isn't found."""

    context_field: str = "context"
    evidence_field: str = "evidences"
    location_field: str = "locations"

    def inputs(self):
        return (self.context_field, self.evidence_field)

    def columns(self, df):
        evidence, _ = A.flat(F.col(self.evidence_field), df.schema[self.evidence_field].dataType)

        def place(e):
            at = F.instr(F.col(self.context_field), e) - 1
            return F.when(at < 0, F.array(F.lit(-1), F.lit(-1))).otherwise(F.array(at, at + F.length(e)))

        return {self.location_field: F.transform(evidence, place)}

    def outputs(self, df):
        return [self.location_field]


