"""Dropping rows by a comparison on every leaf of a field."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import Operator


def _truth(made):
    def test(c: Column, kind: T.DataType, value: Any) -> Column:
        out = made(c, F.lit(value), value)
        return F.length(F.concat(c, F.lit(value))) > 0 if isinstance(kind, T.StringType) else out != F.lit(0)

    return test


def _plain(made):
    return lambda c, kind, value: made(c, F.lit(value), value)


def _bits(made, logic):
    def test(c, kind, value):
        return logic(c, F.lit(value)) if isinstance(kind, T.BooleanType) else made(c, value) != 0

    return test


#: Each as operator(field, value).
OPERATORS = {
    "+": _truth(lambda c, v, _: c + v),
    "-": _truth(lambda c, v, _: c - v),
    "*": _truth(lambda c, v, _: c * v),
    "/": _truth(lambda c, v, _: c.cast("double") / v),
    "%": _truth(lambda c, v, _: c % v),
    "**": _truth(lambda c, v, _: F.pow(c, v)),
    "<<": _truth(lambda c, v, raw: F.shiftleft(c.cast("long"), raw)),
    ">>": _truth(lambda c, v, raw: F.shiftright(c.cast("long"), raw)),
    "&": _bits(lambda c, v: c.bitwiseAND(F.lit(v)), lambda c, v: c & v),
    "|": _bits(lambda c, v: c.bitwiseOR(F.lit(v)), lambda c, v: c | v),
    "^": _bits(lambda c, v: c.bitwiseXOR(F.lit(v)), lambda c, v: c != v),
    "==": _plain(lambda c, v, _: c.eqNullSafe(v)),
    "!=": _plain(lambda c, v, _: ~c.eqNullSafe(v)),
    "<": _plain(lambda c, v, _: c < v),
    "<=": _plain(lambda c, v, _: c <= v),
    ">": _plain(lambda c, v, _: c > v),
    ">=": _plain(lambda c, v, _: c >= v),
    "is": _plain(lambda c, v, _: c.eqNullSafe(v)),
    "is not": _plain(lambda c, v, _: ~c.eqNullSafe(v)),
    "in": _plain(lambda c, v, _: F.contains(c, v)),
    "not in": _plain(lambda c, v, _: ~F.contains(c, v)),
}


@dataclass(frozen=True, eq=False, repr=False)
class Filter(Operator):
    """Keep rows where the comparison holds for every leaf of the field; an empty list passes, an unknown result doesn't.

    "in" asks whether the field contains the value. Comparisons by order with null drop the row.
    """

    kind: ClassVar[str] = "F"
    field_name: str
    operator: str
    value: Any

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator}; there are {', '.join(OPERATORS)}")

    def inputs(self):
        return (self.field_name,)

    def transform(self, df):
        test = OPERATORS[self.operator]
        return df.where(A.every(F.col(self.field_name), df.schema[self.field_name].dataType, lambda c, kind: test(c, kind, self.value)))

    def outputs(self, df):
        return df.columns
