"""Unpacking, flattening, striding, packing and masking of lists."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import ORDER, FieldError, Operator, extended
from .tokenize import TokenizerSpec


def _fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORDER]


@dataclass(frozen=True, eq=False, repr=False)
class Unpacking(Operator):
    """One row for each position of the unpacked lists, as many as the shortest has; other fields are repeated or dropped."""

    kind: ClassVar[str] = "G"
    fields_to_unpack: tuple[str, ...] | None = None
    fields_to_ignore: tuple[str, ...] | None = None
    ignored_behavior: str | None = None

    def __post_init__(self):
        if self.fields_to_unpack is not None and self.fields_to_ignore is not None:
            raise ValueError("give fields_to_unpack or fields_to_ignore")
        if (self.fields_to_unpack is not None or self.fields_to_ignore is not None) and self.ignored_behavior not in ("drop", "repeat"):
            raise ValueError("ignored_behavior is drop or repeat")

    def inputs(self):
        return tuple(self.fields_to_unpack or self.fields_to_ignore or ())

    def transform(self, df):
        names = _fields(df)
        some = list(self.fields_to_unpack) if self.fields_to_unpack is not None else [c for c in names if c not in (self.fields_to_ignore or ())]
        if not some:
            raise ValueError("nothing to unpack")
        for c in some:
            if not isinstance(df.schema[c].dataType, T.ArrayType):
                raise FieldError(f"{c} isn't a list")
        sizes = [F.size(c) for c in some]
        n = F.least(*sizes) if len(sizes) > 1 else sizes[0]
        zipped = F.arrays_zip(*[F.slice(c, 1, n).alias(c) for c in some])
        rest = [c for c in names if c not in some] if self.ignored_behavior == "repeat" else []
        order = [ORDER] if ORDER in df.columns else []
        out = df.select(*rest, *order, F.posexplode(zipped).alias("__pos", "__x"))
        pick = [F.col("__x")[c].alias(c) if c in some else F.col(c) for c in names if c in some or c in rest]
        return extended(out.select(*pick, *order, "__pos"), "__pos")

    def outputs(self, df):
        return df.columns


@dataclass(frozen=True, eq=False, repr=False)
class Flatten(Operator):
    """All levels of nested lists made one."""

    fields: tuple[str, ...]

    def inputs(self):
        return tuple(self.fields)

    def columns(self, df):
        return {c: A.flat(F.col(c), df.schema[c].dataType)[0] for c in self.fields}

    def outputs(self, df):
        return list(self.fields)


@dataclass(frozen=True, eq=False, repr=False)
class SingleSequenceStrider(Operator):
    """Windows of max_length at every stride over the first field; the other listed fields are cut alike, the rest repeated.

    A sequence shorter than max_length gives one row. Without keep_last, what the last full window doesn't reach is dropped; with it, windows go on to
    the end and get shorter.
    """

    kind: ClassVar[str] = "G"
    field_to_stride: tuple[str, ...]
    max_length: int
    stride: int | None = None
    keep_last: bool = False

    def inputs(self):
        return tuple(self.field_to_stride)

    def _starts(self, df):
        first = self.field_to_stride[0]
        n, step = A.size_of(F.col(first), df.schema[first].dataType), F.lit(self.stride or self.max_length)
        if self.keep_last:
            last = F.greatest(n - 1, F.lit(0))
        else:
            last = F.greatest(n - self.max_length, F.lit(0))
        return F.when(n < self.max_length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, step))

    def _windows(self, df):
        return df.select("*", F.posexplode(self._starts(df)).alias("__pos", "__at"))

    def transform(self, df):
        """Windows are cut before a row becomes several, so that no row holds a whole sequence for each of its windows."""
        cut = lambda at: F.struct(*[A.cut(F.col(c), df.schema[c].dataType, at, F.lit(self.max_length)).alias(c) for c in dict.fromkeys(self.field_to_stride)])
        rest = [F.col(c) for c in df.columns if c not in self.field_to_stride]
        out = df.select(*rest, F.posexplode(F.transform(self._starts(df), cut)).alias("__pos", "__cut"))
        return extended(out.select(*[F.col("__cut")[c].alias(c) if c in self.field_to_stride else F.col(c) for c in df.columns], "__pos"), "__pos")

    def outputs(self, df):
        return list(self.field_to_stride)


@dataclass(frozen=True, eq=False, repr=False)
class SingleSequenceStriderWithLocations(SingleSequenceStrider):
    """As SingleSequenceStrider; windows that touch none of the [start, end) locations get the replacement values.

    The span of a window is counted from the lengths of the windows before it, or with true_offsets from its place in the sequence.
    """

    field_with_locations: str = ""
    fields_replacement_map: dict[str, Any] | None = None
    true_offsets: bool = False

    def inputs(self):
        return (*self.field_to_stride, self.field_with_locations)

    def transform(self, df):
        first = self.field_to_stride[0]
        out = self._windows(df)
        size = F.least(A.size_of(F.col(first), df.schema[first].dataType) - F.col("__at"), F.lit(self.max_length))
        begin = F.col("__at") if self.true_offsets else F.col("__pos") * self.max_length
        out = out.withColumn("__b", begin).withColumn("__e", begin + size)
        hit = F.exists(F.col(self.field_with_locations), lambda p: ((F.col("__b") <= p[0]) & (p[0] < F.col("__e"))) | ((F.col("__b") < p[1]) & (p[1] <= F.col("__e"))))
        cut = {c: A.cut(F.col(c), df.schema[c].dataType, F.col("__at"), F.lit(self.max_length)) for c in self.field_to_stride}
        cut |= {c: F.when(hit, cut.get(c, F.col(c))).otherwise(F.lit(v)) for c, v in (self.fields_replacement_map or {}).items()}
        return extended(out.withColumns(cut).drop("__at", "__b", "__e"), "__pos")


#: Sequences that the packing fold takes at a time: it copies at most this many groups at each step.
_BLOCK = 256


def _packed(sizes: Column, most: Column, count: Column) -> Column:
    """[start, end) of consecutive groups of at most count sizes and a sum of at most most; one empty group for no sizes.

    A fold over blocks of sizes, with a fold over the sizes in it, so that a long list of groups isn't copied at each size.
    """
    n = F.size(sizes)
    span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    state = lambda s, c, done: F.struct(s.cast("int").alias("s"), c.cast("long").alias("c"), done.alias("done"))
    none = F.slice(F.array(span(F.lit(0), F.lit(0))), 1, 0)

    def step(a, v):
        full = (v["j"] > a["s"]) & ((a["c"] + v["x"] > most) | (v["j"] - a["s"] >= count))
        x = A.fail_if(v["x"] > most, "a sequence is longer than max_length", v["x"])
        return F.when(full, state(v["j"], x, F.concat(a["done"], F.array(span(a["s"], v["j"]))))).otherwise(state(a["s"], a["c"] + x, a["done"]))

    def block(a, b):
        last = F.aggregate(b, state(a["last"]["s"], a["last"]["c"], none), step)
        return F.struct(last.alias("last"), F.concat(a["blocks"], F.array(a["last"]["done"])).alias("blocks"))

    blocks = F.transform(A.upto(F.ceil(n / _BLOCK).cast("int")), lambda k: F.transform(F.slice(sizes, k * _BLOCK + 1, _BLOCK), lambda x, i: F.struct((k * _BLOCK + i).cast("int").alias("j"), x.alias("x"))))
    start = F.struct(state(F.lit(0), F.lit(0), none).alias("last"), F.slice(F.array(none), 1, 0).alias("blocks"))
    return F.when(sizes.isNotNull(), F.aggregate(blocks, start, block, lambda a: F.concat(F.flatten(a["blocks"]), a["last"]["done"], F.array(span(a["last"]["s"], n)))))


@dataclass(frozen=True, eq=False, repr=False)
class MultiSequenceStrider(Operator):
    """Pack consecutive sequences of a list into groups of at most max_stride_count, and max_length symbols with extra_length_per_seq each.

    Where no extra length is given, a tokenizer sets it: room on both sides for its longest separator.
    """

    kind: ClassVar[str] = "G"
    max_stride_count: int
    length_reference_field: str
    fields_to_stride: tuple[str, ...] | None = None
    max_length: int | None = None
    extra_length_per_seq: int | None = None
    tokenizer: TokenizerSpec | None = None

    def inputs(self):
        return tuple(dict.fromkeys((self.length_reference_field, *(self.fields_to_stride or ()))))

    def transform(self, df):
        some = self.fields_to_stride or [c for c in _fields(df) if A.depth(df.schema[c].dataType) > 1]
        most, count = F.lit(self.max_length if self.max_length is not None else 2**31 - 1).cast("long"), F.lit(self.max_stride_count)
        separators = (self.tokenizer.bos, self.tokenizer.sep, self.tokenizer.eos) if self.tokenizer else ()
        extra = self.extra_length_per_seq if self.extra_length_per_seq is not None else 2 * max(map(len, separators), default=0)
        groups = _packed(F.transform(F.col(self.length_reference_field), lambda x: (F.size(x) + extra).cast("long")), most, count)
        rest = [c for c in _fields(df) if c not in some]
        order = [ORDER] if ORDER in df.columns else []
        cut = F.transform("__g", lambda g: F.struct(*[F.slice(F.col(c), g["s"] + 1, g["e"] - g["s"]).alias(c) for c in some]))
        out = df.withColumn("__g", groups).select(*rest, *order, F.posexplode(cut).alias("__pos", "__x"))  # lists are cut before a row becomes several
        pick = [F.col("__x")[c].alias(c) if c in some else F.col(c) for c in _fields(df)]
        return extended(out.select(*pick, *order, "__pos"), "__pos")

    def outputs(self, df):
        return list(self.fields_to_stride or df.columns)


@dataclass(frozen=True, eq=False, repr=False)
class SequencesConcatenate(Operator):
    """One level of nesting removed from the listed fields, or from all."""

    concat_fields: tuple[str, ...] | None = None

    def inputs(self):
        return tuple(self.concat_fields or ())

    def columns(self, df):
        return {c: F.flatten(c) for c in self.concat_fields or _fields(df)}

    def outputs(self, df):
        return list(self.concat_fields or _fields(df))


@dataclass(frozen=True, eq=False, repr=False)
class SingleValueToSequence(Operator):
    """Each value becomes a list as long as its sequence in like_field: value first, last or everywhere, padding elsewhere."""

    single_value_field: str
    like_field: str = "input_ids"
    strategy: str = "first"
    padding_id: int = -100

    def __post_init__(self):
        if self.strategy not in ("first", "last", "all"):
            raise ValueError("strategy is first, last or all")

    def inputs(self):
        return (self.single_value_field, self.like_field)

    def columns(self, df):
        pad = F.lit(self.padding_id).cast(df.schema[self.single_value_field].dataType.elementType)

        def spread(v, s):
            rest = A.filled(pad, F.size(s) - 1)
            return {"first": F.concat(F.array(v), rest), "last": F.concat(rest, F.array(v)), "all": A.filled(v, F.size(s))}[self.strategy]

        return {self.single_value_field: F.zip_with(F.col(self.single_value_field), F.col(self.like_field), spread)}

    def outputs(self, df):
        return [self.single_value_field]


@dataclass(frozen=True, eq=False, repr=False)
class LabelsMasker(Operator):
    """all: nothing masked. one: a row for each label, with only that label. sample: labels dealt at random to rows of max(int(n * sample_prob), 1)."""

    kind: ClassVar[str] = "G"
    labels_field: str = "labels"
    strategy: str = "all"
    sample_prob: float | None = None
    label_mask_id: int = -100
    seed: int = 0

    def __post_init__(self):
        if self.strategy not in ("all", "one", "sample") or (self.strategy == "sample") != (self.sample_prob is not None):
            raise ValueError("strategy is all, one or sample; sample needs sample_prob")

    def inputs(self):
        return (self.labels_field,)

    def transform(self, df):
        if self.strategy == "all":
            return df
        labels, mask = F.col(self.labels_field), F.lit(self.label_mask_id).cast(df.schema[self.labels_field].dataType.elementType)
        n = F.size(labels)
        if self.strategy == "one":
            chunks = F.transform(A.upto(n), lambda i: F.array(i))
        else:
            ranked = F.array_sort(F.transform(A.upto(n), lambda i: F.struct(F.xxhash64(F.to_json(F.struct(labels)), i, F.lit(self.seed)).alias("h"), i.alias("i"))))
            size = F.greatest(F.floor(n * self.sample_prob), F.lit(1)).cast("int")
            chunks = F.transform(A.upto(F.ceil(n / size).cast("int")), lambda k: F.transform(F.slice(ranked, k * size + 1, size), lambda x: x["i"]))
        out = df.select("*", F.posexplode(chunks).alias("__pos", "__c"))
        kept = F.transform(labels, lambda x, i: F.when(F.array_contains(F.col("__c"), i), x).otherwise(mask))
        return extended(out.withColumn(self.labels_field, kept).drop("__c"), "__pos")

    def outputs(self, df):
        return [self.labels_field]
