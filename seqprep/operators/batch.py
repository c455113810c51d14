"""Consecutive rows as batches, and padding of batches to rectangles."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import ORDER, Operator, dense


@dataclass(frozen=True, eq=False, repr=False)
class FixedBatchSize(Operator):
    """batch_size consecutive rows become one whose fields are lists; "max": all rows, for small inputs (one row, built in one task)."""

    kind: ClassVar[str] = "B"
    batch_size: int | str
    keep_last: bool = True

    def __post_init__(self):
        if self.batch_size != "max" and (not isinstance(self.batch_size, int) or self.batch_size < 1):
            raise ValueError("batch_size is a positive int or max")

    def transform(self, df):
        names = [c for c in df.columns if c != ORDER]
        rows = dense(df)
        group = F.lit(0).cast("long") if self.batch_size == "max" else F.floor(F.col(ORDER) / self.batch_size)
        out = rows.groupBy(group.alias("__g")).agg(F.sort_array(F.collect_list(F.struct(ORDER, F.struct(*names).alias("r")))).alias("__b"))
        if self.batch_size != "max" and not self.keep_last:
            out = out.where(F.size("__b") == self.batch_size)
        return out.select(*[_column("__b", c).alias(c) for c in names], F.array("__g").alias(ORDER))

    def outputs(self, df):
        return df.columns


def _column(batch: str, name: str) -> Column:
    return F.transform(batch, lambda x: x["r"][name])


def pad_list(c: Column, kind: T.DataType, sizes: list[Column], value: Column, left: bool = False, left_all: bool = False) -> Column:
    """c with its outer list padded to sizes[0], the lists in it to sizes[1] and so on; missing inner lists are made."""

    def empty(kind, sizes):
        return A.filled(empty(kind.elementType, sizes[1:]) if isinstance(kind.elementType, T.ArrayType) else value, sizes[0])

    inner = kind.elementType
    if isinstance(inner, T.ArrayType):
        c = F.transform(c, lambda x: pad_list(x, inner, sizes[1:], value, left_all, left_all))
        more = empty(inner, sizes[1:])
    else:
        more = value
    fill = A.filled(more, sizes[0] - F.size(c))
    return F.concat(fill, c) if left else F.concat(c, fill)


def widths(c: Column, kind: T.DataType) -> list[Column]:
    """Largest length of each level of a nested list below the outermost."""
    out = []
    kind = kind.elementType
    while isinstance(kind, T.ArrayType):
        out.append(F.coalesce(F.array_max(F.transform(c, lambda x: F.size(x))), F.lit(0)))
        c, kind = F.flatten(c), kind.elementType
    return out


@dataclass(frozen=True, eq=False, repr=False)
class ListCollator(Operator):
    """Pad every field of a batch to its largest shape, to multiples of a number, or to a fixed length (longer ones are errors).

    Pad values by field, else unk_fields_pad_id. left_pad_fields are padded on the left at the level of the sequences; with left_everywhere
    at every level below the batch.
    """

    pad_to_length: int | tuple[int, ...] | None = None
    pad_to_multiple_of: int | None = None
    fields_pad_ids: dict[str, Any] | None = None
    unk_fields_pad_id: Any = None
    left_pad_fields: tuple[str, ...] | None = None
    left_everywhere: bool = False

    def _sizes(self, c, kind):
        sizes = widths(c, kind)
        if self.pad_to_multiple_of:
            k = self.pad_to_multiple_of
            return [(F.ceil(s / k) * k).cast("int") for s in sizes]
        if self.pad_to_length is not None:
            want = self.pad_to_length if isinstance(self.pad_to_length, (tuple, list)) else (self.pad_to_length,) * len(sizes)
            return [A.fail_if(s > w, "a sequence is longer than pad_to_length", F.lit(w)) for s, w in zip(sizes, want, strict=True)]
        return sizes

    def columns(self, df):
        out = {}
        for f in df.schema:
            if f.name == ORDER or A.depth(f.dataType) < 2:
                continue
            value = (self.fields_pad_ids or {}).get(f.name, self.unk_fields_pad_id)
            if value is None:
                raise ValueError(f"no pad value for {f.name}")
            value = F.lit(value).cast(A.leaf_type(f.dataType))
            out[f.name] = self._padded(F.col(f.name), f.dataType, value, f.name in (self.left_pad_fields or ()))
        return out

    def _padded(self, c, kind, value, left):
        sizes = self._sizes(c, kind)
        return F.transform(c, lambda x: pad_list(x, kind.elementType, sizes, value, left, left and self.left_everywhere))

    def outputs(self, df):
        return df.columns


def tensor_collator(**options: Any) -> ListCollator:
    """The collator of dense arrays: left padding applies at every level."""
    return ListCollator(left_everywhere=True, **options)


def pad_ids_of(spec) -> dict[str, int]:
    """Pad values of a tokenizer's outputs."""
    return {"input_ids": spec.pad_id, "token_type_ids": spec.pad_type_id} | dict.fromkeys(("attention_mask", "overflow_to_sample_mapping", "special_tokens_mask", "offset_mapping", "length"), 0)


def from_tokenizer_collator(spec, fields_pad_ids: dict[str, Any] | None = None, tensors: bool = False, **options: Any) -> ListCollator:
    return ListCollator(fields_pad_ids=pad_ids_of(spec) | (fields_pad_ids or {}), left_everywhere=tensors, **options)


@dataclass(frozen=True, eq=False, repr=False)
class Padding(Operator):
    """Pad lists on the right to a fixed length; longer ones are errors."""

    pad_to_length: int
    pad_value: Any
    fields_to_pad: tuple[str, ...] | None = None

    def inputs(self):
        return tuple(self.fields_to_pad or ())

    def columns(self, df):
        def pad(c, kind):
            if isinstance(kind.elementType, T.ArrayType):
                return F.transform(c, lambda x: pad(x, kind.elementType))
            return A.fail_if(F.size(c) > self.pad_to_length, "a list is longer than pad_to_length", F.concat(c, A.filled(F.lit(self.pad_value).cast(kind.elementType), self.pad_to_length - F.size(c))))

        names = self.fields_to_pad or [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and f.name != ORDER]
        return {c: pad(F.col(c), df.schema[c].dataType) for c in names}

    def outputs(self, df):
        return list(self.fields_to_pad or df.columns)


def collate(rows: list[dict[str, Any]], collator: ListCollator, spark, schema: str) -> dict[str, list]:
    """A list of samples as one padded batch (the hook of a data loader)."""
    df = spark.createDataFrame(rows, schema)
    return (FixedBatchSize("max") >> collator).map(df.coalesce(1)).first().asDict(recursive=True)


def batches(df: DataFrame):
    """Rows of a batched DataFrame one after another on the driver, a partition at a time."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)
