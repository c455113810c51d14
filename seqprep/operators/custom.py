"""User-defined operators, and operators for debugging and tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, ClassVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..plans.core import ORDER, Operator, dense, extended


@dataclass(frozen=True, eq=False, repr=False)
class RowFunction(Operator):
    """A function from a sample (dict) to new fields (dict), for each row; schema: DDL of the new fields."""

    function: Callable[[dict[str, Any]], dict[str, Any]]
    schema: str
    input_fields: tuple[str, ...] = ()

    def inputs(self):
        return tuple(self.input_fields)

    def outputs(self, df):
        return T._parse_datatype_string(self.schema).names

    def transform(self, df):
        made = T._parse_datatype_string(self.schema)
        call, names = self.function, made.names
        kept = [f for f in df.schema if f.name not in names]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [call(dict(zip(frame.columns, r, strict=True))) for r in frame.itertuples(index=False, name=None)]
                yield frame[[f.name for f in kept]].assign(**{n: pd.Series([r[n] for r in rows], dtype=object, index=frame.index) for n in names})

        return df.mapInPandas(run, T.StructType([*kept, *made.fields]))


@dataclass(frozen=True, eq=False, repr=False)
class BatchFunction(Operator):
    """A function from an iterable of samples to an iterable of samples, over every group of batch_size consecutive rows; its samples replace the rows.

    batch_size "max": one group of all rows, in one task; for functions that need the whole of a small dataset.
    """

    kind: ClassVar[str] = "B"
    function: Callable[[Iterable[dict[str, Any]]], Iterable[dict[str, Any]]]
    schema: str
    batch_size: int | str
    input_fields: tuple[str, ...] = ()

    def __post_init__(self):
        if self.batch_size != "max" and (not isinstance(self.batch_size, int) or self.batch_size < 1):
            raise ValueError('batch_size is a positive number or "max"')

    def inputs(self):
        return tuple(self.input_fields)

    def outputs(self, df):
        return T._parse_datatype_string(self.schema).names

    def transform(self, df):
        call, made = self.function, T._parse_datatype_string(self.schema)

        def run(key, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(ORDER).drop(columns=[ORDER, "__g"])
            rows = list(call(dict(zip(frame.columns, r, strict=True)) for r in frame.itertuples(index=False, name=None)))
            return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in made.names} | {ORDER: [[int(key[0]), i] for i in range(len(rows))]})

        return dense(df).withColumn("__g", F.lit(0).cast("long") if self.batch_size == "max" else F.floor(F.col(ORDER) / self.batch_size)).groupBy("__g").applyInPandas(run, T.StructType([*made.fields, T.StructField(ORDER, T.ArrayType(T.LongType()))]))


@dataclass(frozen=True, eq=False, repr=False)
class TableFunction(Operator):
    """Samples from samples by a table function of Spark's, sent by Arrow: a generator over a sample (dict), or a class with each(sample) and end().

    schema is the DDL of the new samples, or a function from the type of the samples to theirs, which is asked while Spark analyses the query.
    Without partition_by, each row is a call (a lateral join): its other fields are repeated, new fields replace those of the same name, and a row without new
    samples goes. A class is made anew for each task's rows and end() isn't allowed. With partition_by, new samples replace the rows: one object sees
    the rows of one value of those fields, in order of order_by, one at a time, then end(); what it keeps is all that a large value costs. Rows that are null
    in partition_by are one value.
    """

    kind: ClassVar[str] = "G"
    function: Callable[[dict[str, Any]], Iterable[dict[str, Any]]] | type
    schema: str | Callable[[T.StructType], T.StructType]
    input_fields: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()

    def __post_init__(self):
        if self.order_by and not self.partition_by:
            raise ValueError("order_by needs partition_by")
        if not self.partition_by and hasattr(self.function, "end"):
            raise ValueError("end() needs partition_by")

    def inputs(self):
        return tuple(dict.fromkeys((*self.input_fields, *self.partition_by, *self.order_by)))

    def made(self, kind: T.StructType) -> T.StructType:
        return T._parse_datatype_string(self.schema) if isinstance(self.schema, str) else self.schema(kind)

    def outputs(self, df):
        return T._parse_datatype_string(self.schema).names if isinstance(self.schema, str) else df.columns

    def _handler(self, new: T.StructType, kept: tuple[str, ...]) -> type:
        """The class that Spark calls; kept: fields of a partition's first row that go along with the new samples."""
        function, schema, by, order, names = self.function, self.schema, self.partition_by, self.order_by, new.names

        class Handler:
            @staticmethod
            def analyze(row: AnalyzeArgument) -> AnalyzeResult:
                given = T.StructType([f for f in row.dataType if f.name != ORDER])
                found = new if isinstance(schema, str) else schema(given)
                fields = [*found.fields, *[row.dataType[c] for c in kept], T.StructField("__pos", T.LongType())]
                return AnalyzeResult(schema=T.StructType(fields), partitionBy=[PartitioningColumn(c) for c in by], orderBy=[OrderingColumn(c) for c in order])

            def __init__(self):
                self.own = function() if isinstance(function, type) else None
                self.count, self.first, self.fresh = 0, (), True

            def _rows(self, samples: Iterable[dict[str, Any]] | None) -> Iterator[tuple]:
                for sample in samples or ():
                    yield (*[sample[n] for n in names], *self.first, self.count)
                    self.count += 1

            def eval(self, row):
                sample = row.asDict(recursive=True)
                carried = tuple(sample.pop(c) for c in kept)
                if not by:
                    self.count = 0
                elif self.fresh:
                    self.first, self.fresh = carried, False
                yield from self._rows(self.own.each(sample) if self.own is not None else function(sample))

            def terminate(self):
                if by and hasattr(self.own, "end"):
                    yield from self._rows(self.own.end())

        return Handler

    def transform(self, df):
        kind = T.StructType([f for f in df.schema if f.name != ORDER])
        new = self.made(kind)
        kept = (ORDER,) if ORDER in df.columns and self.partition_by else ()
        call = F.udtf(self._handler(new, kept), useArrow=True)
        if self.partition_by:
            return extended(call(df.asTable()), "__pos")
        some = self.input_fields or tuple(kind.names)
        rest = [c for c in df.columns if c not in new.names]
        rows = df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])
        out = rows.lateralJoin(call(F.struct(*[F.col(f"_{c}").outer().alias(c) for c in some])))
        return extended(out.select(*[F.col(f"_{c}").alias(c) for c in rest], *new.names, "__pos"), "__pos")


@dataclass(frozen=True, eq=False, repr=False)
class AddConstant(Operator):
    """value added to every field, or to the listed ones; lists are concatenated."""

    value: Any
    fields: tuple[str, ...] | None = None

    def inputs(self):
        return tuple(self.fields or ())

    def columns(self, df):
        names = self.fields or [c for c in df.columns if c != ORDER]
        more = lambda c: F.concat(F.col(c), F.array(*[F.lit(v) for v in self.value])) if isinstance(self.value, (list, tuple)) else F.col(c) + F.lit(self.value)
        return {c: more(c) for c in names}

    def outputs(self, df):
        return list(self.fields or df.columns)


@dataclass(frozen=True, eq=False, repr=False)
class Debug(Operator):
    """Identity that calls a hook with the DataFrame when the pipeline is built (by default prints its plan)."""

    hook: Callable[[DataFrame], Any] = lambda df: df.explain()

    def transform(self, df):
        self.hook(df.drop(ORDER))
        return df

    def outputs(self, df):
        return df.columns


