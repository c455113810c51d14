"""Conversions of leaves: casts, thresholds, lookups, one-hot lists."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import Operator

_NUMBERS = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}
_DENSE = {"int64": "bigint", "long": "bigint", "int32": "int", "int": "int", "int16": "smallint", "short": "smallint", "int8": "tinyint", "uint8": "smallint", "float64": "double", "double": "double", "float32": "float", "float": "float", "float16": "float", "half": "float", "bool": "boolean"}


def _over(df, fields, leaf):
    return {c: A.leaves(F.col(c), df.schema[c].dataType, leaf) for c in fields}


@dataclass(frozen=True, eq=False, repr=False)
class Cast(Operator):
    """int, float, str or bool for each leaf, as Python's constructors: text is true unless empty, what can't be converted is an error."""

    cast_map: dict[str, Any]

    def inputs(self):
        return tuple(self.cast_map)

    def columns(self, df):
        def leaf(to):
            def cast(c, kind):
                text = isinstance(kind, T.StringType)
                if to == "bool" and text:
                    return F.length(c) > 0
                if to == "int" and text:
                    return F.trim(c).cast("bigint")
                if to == "int" and isinstance(kind, (T.DoubleType, T.FloatType)):
                    return c.cast("bigint")
                if to == "str" and isinstance(kind, T.BooleanType):
                    return F.initcap(c.cast("string"))
                return c.cast(_NUMBERS[to])

            return cast

        names = {c: t if isinstance(t, str) else t.__name__ for c, t in self.cast_map.items()}
        unknown = [t for t in names.values() if t not in _NUMBERS]
        if unknown:
            raise ValueError(f"can't cast to {unknown[0]}")
        return {c: _over(df, [c], leaf(t))[c] for c, t in names.items()}

    def outputs(self, df):
        return list(self.cast_map)


@dataclass(frozen=True, eq=False, repr=False)
class Binarizer(Operator):
    """1 for leaves above the threshold, else 0."""

    field: str
    threshold: float

    def inputs(self):
        return (self.field,)

    def columns(self, df):
        return _over(df, [self.field], lambda c, _: (c > self.threshold).cast("int"))

    def outputs(self, df):
        return [self.field]


@dataclass(frozen=True, eq=False, repr=False)
class Lookup(Operator):
    """Each leaf replaced by its entry in a table; a leaf without entry is an error."""

    field_name: str
    lookup_table: dict[Any, Any]

    def __post_init__(self):
        if len({type(k) for k in self.lookup_table}) > 1 or len({type(v) for v in self.lookup_table.values()}) > 1:
            raise ValueError("keys are of one type, and so are values")

    def inputs(self):
        return (self.field_name,)

    def columns(self, df):
        entries = F.create_map(*[F.lit(x) for kv in self.lookup_table.items() for x in kv])
        kind = T._infer_type(next(iter(self.lookup_table.values()))) if self.lookup_table else T.StringType()
        return _over(df, [self.field_name], lambda c, _: F.coalesce(entries[c], F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("no entry for "), c.cast("string"))).cast(kind))))

    def outputs(self, df):
        return [self.field_name]


@dataclass(frozen=True, eq=False, repr=False)
class OneHot(Operator):
    """Each leaf as a list of num_classes zeros with a one at its place; out of range: all zeros."""

    num_classes: int
    field_name: str

    def inputs(self):
        return (self.field_name,)

    def columns(self, df):
        n = F.lit(self.num_classes)
        return _over(df, [self.field_name], lambda c, _: F.transform(A.upto(n), lambda i: F.when(i == c, F.lit(1)).otherwise(F.lit(0))))

    def outputs(self, df):
        return [self.field_name]


@dataclass(frozen=True, eq=False, repr=False)
class ToDense(Operator):
    """Numeric types by the names of tensor types, for the listed fields or none; tensors themselves are made by the sink."""

    field_cast_map: dict[str, str] | None = None

    def inputs(self):
        return tuple(self.field_cast_map or ())

    def columns(self, df):
        kind = {c: _DENSE[str(t).rsplit(".", 1)[-1]] for c, t in (self.field_cast_map or {}).items()}
        return {c: _over(df, [c], lambda x, _, k=k: x.cast(k))[c] for c, k in kind.items()}

    def transform(self, df):
        return df.withColumns(self.columns(df)) if self.field_cast_map else df

    def outputs(self, df):
        return list(self.field_cast_map or df.columns)


@dataclass(frozen=True, eq=False, repr=False)
class FromDense(Operator):
    """Identity: the lists of a DataFrame are already nested lists."""

    def transform(self, df):
        return df

    def outputs(self, df):
        return df.columns
