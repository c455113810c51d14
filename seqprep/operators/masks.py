"""Masks, positions and ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import Operator


@dataclass(frozen=True, eq=False, repr=False)
class IndicesToMask(Operator):
    """A list as long as the reference: fill at the listed positions (negative ones from the end), off elsewhere; out of range is an error."""

    mask_field_name: str
    reference_field_name: str
    locations_field_name: str
    mask_off_value: int = 0
    mask_fill_value: int = 1

    def inputs(self):
        return (self.reference_field_name, self.locations_field_name)

    def _locations(self, df):
        c = F.col(self.locations_field_name)
        return c if isinstance(df.schema[self.locations_field_name].dataType, T.ArrayType) else F.array(c)

    def columns(self, df):
        ref, at = F.col(self.reference_field_name), self._locations(df)
        n = F.size(ref)
        mask = F.transform(ref, lambda _, i: F.when(F.exists(at, lambda x: (x == i) | (x == i - n)), F.lit(self.mask_fill_value)).otherwise(F.lit(self.mask_off_value)))
        return {self.mask_field_name: A.fail_if(F.exists(at, lambda x: (x >= n) | (x < -n)), "position out of range", mask)}

    def outputs(self, df):
        return [self.mask_field_name]


@dataclass(frozen=True, eq=False, repr=False)
class RangeToMask(IndicesToMask):
    """As IndicesToMask for one [start, end) or a list of them, with slice rules: clamped, negative from the end."""

    def columns(self, df):
        ref, n = F.col(self.reference_field_name), F.size(F.col(self.reference_field_name))
        kind = df.schema[self.locations_field_name].dataType
        at = F.col(self.locations_field_name) if A.depth(kind) > 1 else F.when(F.size(self.locations_field_name) == 0, F.array().cast(T.ArrayType(kind))).otherwise(F.array(F.col(self.locations_field_name)))
        place = lambda x: F.when(x < 0, x + n).otherwise(x)
        hit = lambda i: F.exists(at, lambda p: (i >= place(p[0])) & (i < place(p[1])))
        return {self.mask_field_name: F.transform(ref, lambda _, i: F.when(hit(i), F.lit(self.mask_fill_value)).otherwise(F.lit(self.mask_off_value)))}


@dataclass(frozen=True, eq=False, repr=False)
class MaskToIndices(Operator):
    """Positions of the fill value; enforce_single_location: the only one, else an error."""

    mask_field_name: str
    locations_field_name: str
    mask_off_value: int = 0
    mask_fill_value: int = 1
    enforce_single_location: bool = False

    def inputs(self):
        return (self.mask_field_name,)

    def _found(self):
        m = F.col(self.mask_field_name)
        return F.filter(A.upto(F.size(m)), lambda i: F.get(m, i) == self.mask_fill_value)

    def columns(self, df):
        found = self._found()
        return {self.locations_field_name: A.fail_if(F.size(found) != 1, "not exactly one location", F.get(found, F.lit(0))) if self.enforce_single_location else found}

    def outputs(self, df):
        return [self.locations_field_name]


@dataclass(frozen=True, eq=False, repr=False)
class MaskToRange(MaskToIndices):
    """Runs of the fill value as [start, end)."""

    def _found(self):
        m, n = F.col(self.mask_field_name), F.size(F.col(self.mask_field_name))
        on = lambda i: F.coalesce(F.get(m, i) == self.mask_fill_value, F.lit(False))
        starts = F.filter(A.upto(n), lambda i: on(i) & ((i == 0) | ~on(F.greatest(i - 1, F.lit(0)))))
        ends = F.transform(F.filter(A.upto(n), lambda i: on(i) & ((i == n - 1) | ~on(i + 1))), lambda i: i + 1)
        return F.zip_with(starts, ends, lambda a, b: F.array(a, b))


@dataclass(frozen=True, eq=False, repr=False)
class MakeAttentionMask(Operator):
    """Ones in the shape of a list of lists."""

    input_field: str = "input_ids"
    output_field: str = "attention_mask"

    def inputs(self):
        return (self.input_field,)

    def columns(self, df):
        return {self.output_field: A.leaves(F.col(self.input_field), df.schema[self.input_field].dataType, lambda *_: F.lit(1))}

    def outputs(self, df):
        return [self.output_field]


@dataclass(frozen=True, eq=False, repr=False)
class OneVsOther(Operator):
    """preds: the annotation at a position; labels: the mean of the others. Fewer than two are an error."""

    input_field: str = "annotations"
    label_field: str = "labels"
    preds_field: str = "preds"
    position: int = 0

    def inputs(self):
        return (self.input_field,)

    def columns(self, df):
        c, p = F.col(self.input_field), self.position
        others = F.filter(c, lambda _, i: i != p)
        mean = F.aggregate(others, F.lit(0.0), lambda a, x: a + x) / F.size(others)
        return {self.preds_field: A.fail_if(F.size(c) < 2, "fewer than two annotations", F.get(c, F.lit(p))), self.label_field: A.fail_if(F.size(c) < 2, "fewer than two annotations", mean)}

    def outputs(self, df):
        return [self.label_field, self.preds_field]


@dataclass(frozen=True, eq=False, repr=False)
class UniqueAnswer(Operator):
    """A list without repeats, in order of first appearance."""

    answer_field: str = "answers"

    def inputs(self):
        return (self.answer_field,)

    def columns(self, df):
        return {self.answer_field: F.array_distinct(self.answer_field)}

    def outputs(self, df):
        return [self.answer_field]
