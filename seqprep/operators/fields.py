"""Selecting, renaming, making and numbering fields; extracting nested values."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import ORDER, FieldError, Operator, dense


@dataclass(frozen=True, eq=False, repr=False)
class ChangeFields(Operator):
    """Keep or drop the listed fields (exactly one list); the order of fields stays."""

    keep_fields: tuple[str, ...] | None = None
    drop_fields: tuple[str, ...] | None = None
    raise_on_missing: bool = True

    def __post_init__(self):
        if (self.keep_fields is None) == (self.drop_fields is None):
            raise ValueError("give keep_fields or drop_fields")

    def inputs(self):
        return tuple(self.keep_fields if self.keep_fields is not None else self.drop_fields) if self.raise_on_missing else ()

    def transform(self, df):
        if self.drop_fields is not None:
            return df.drop(*self.drop_fields)
        return df.select(*[c for c in df.columns if c in self.keep_fields or c == ORDER])

    def outputs(self, df):
        return df.columns


@dataclass(frozen=True, eq=False, repr=False)
class RenameFields(Operator):
    """Rename at once, in place; where names clash the later field wins."""

    rename_fields_map: dict[str, str]
    remove_rest: bool = False

    def inputs(self):
        return tuple(self.rename_fields_map)

    def transform(self, df):
        named: dict[str, Column] = {}
        for c in df.columns:
            if c in self.rename_fields_map or c == ORDER or not self.remove_rest:
                to = self.rename_fields_map.get(c, c)
                named[to] = F.col(f"`{c}`").alias(to)
        return df.select(*named.values())

    def outputs(self, df):
        return list(self.rename_fields_map.values())


@dataclass(frozen=True, eq=False, repr=False)
class MakeField(Operator):
    """A constant field; with shape_like, a list of it as long as that field."""

    field_name: str
    value: Any
    shape_like: str | None = None

    def inputs(self):
        return (self.shape_like,) if self.shape_like else ()

    def columns(self, df):
        value = F.lit(self.value)
        return {self.field_name: F.transform(F.col(self.shape_like), lambda _: value) if self.shape_like else value}

    def outputs(self, df):
        return [self.field_name]


@dataclass(frozen=True, eq=False, repr=False)
class EnumerateField(Operator):
    """Number rows from 0, or distinct values by first appearance. Distinct values are grouped and numbered once, then joined."""

    kind: ClassVar[str] = "S"
    field: str
    destination_field: str | None = None
    same_id_for_repeated: bool = True

    def inputs(self):
        return (self.field,)

    def transform(self, df):
        to = self.destination_field or self.field
        df = dense(df)
        if not self.same_id_for_repeated:
            return df.withColumn(to, F.col(ORDER)).withColumn(ORDER, F.array(ORDER))
        firsts = df.groupBy(F.col(self.field).alias("_v")).agg(F.min(ORDER).alias("_f"))
        from ..plans.storage import numbered

        ids = numbered(firsts, [F.col("_f")], "_id").select("_v", "_id")
        out = df.join(ids, F.col(self.field).eqNullSafe(F.col("_v"))).withColumn(to, F.col("_id")).drop("_v", "_id")
        return out.withColumn(ORDER, F.array(ORDER))

    def outputs(self, df):
        return [self.destination_field or self.field]


def _variant(c: Column, steps: Any) -> Column:
    """A step or dotted steps into a variant, as a variant; missing: null. A list [step]: an array of variants, one for each element."""
    if isinstance(steps, list):
        return F.transform(F.variant_get(c, "$", "array<variant>"), lambda x: path(x, T.VariantType(), tuple(steps))[0])
    for step in str(steps).split("."):
        if re.fullmatch(r"-\d+", step):
            c = F.try_element_at(F.try_variant_get(c, "$", "array<variant>"), F.lit(int(step)))
        elif step.isdigit():
            c = F.coalesce(F.try_variant_get(c, f"$[{step}]", "variant"), F.try_variant_get(c, f"$['{step}']", "variant"))
        else:
            mark = '"' if "'" in step else "'"
            c = F.try_variant_get(c, f"$[{mark}{step}{mark}]", "variant")
    return c


def path(c: Column, kind: T.DataType, steps: Any) -> tuple[Column, T.DataType]:
    """Follow a path: a dotted string, a tuple of steps in turn, a list [step] for each element; numbers index, from the end if negative."""
    if isinstance(steps, tuple):
        for s in steps:
            c, kind = path(c, kind, s)
        return c, kind
    if isinstance(kind, T.VariantType) and steps not in ([], ""):
        return _variant(c, steps), kind if not isinstance(steps, list) else T.ArrayType(kind)
    if isinstance(steps, list):
        if not isinstance(kind, T.ArrayType):
            raise FieldError(f"{steps} needs a list, not {kind.simpleString()}")
        if not steps:
            return c, kind
        return F.transform(c, lambda x: path(x, kind.elementType, tuple(steps))[0]), T.ArrayType(path(c, kind.elementType, tuple(steps))[1])
    for step in str(steps).split(".") if steps != "" else []:
        if isinstance(kind, T.ArrayType):
            k = int(step)
            c, kind = F.element_at(c, k + 1 if k >= 0 else k), kind.elementType
        elif isinstance(kind, T.StructType):
            if step not in kind.names:
                raise FieldError(f"no {step} in {kind.simpleString()}")
            c, kind = c.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType):
            c, kind = A.fail_if(~F.map_contains_key(c, F.lit(step)), f"no {step}", F.element_at(c, F.lit(step))), kind.valueType
        elif isinstance(kind, T.StringType):
            c = F.get_json_object(c, f"$['{step}']")
        else:
            raise FieldError(f"{step} can't be looked up in {kind.simpleString()}")
    return c, kind


@dataclass(frozen=True, eq=False, repr=False)
class ExtractPath(Operator):
    """New fields from paths into nested fields: {name: path}, where a path starts with a field's name.

    What a path finds in a variant gets the type that types (DDL) names, else stays a variant. A value that can't be cast to it is an error, a JSON null is
    null, and a path that leads nowhere is an error or, with missing="null", null.
    """

    spec_fields: dict[str, Any]
    types: dict[str, str] | None = None
    missing: str = "error"

    def __post_init__(self):
        if self.missing not in ("error", "null"):
            raise ValueError("missing is error or null")
        if unknown := set(self.types or ()) - set(self.spec_fields):
            raise ValueError(f"no path {min(unknown)}")

    def columns(self, df):
        kind = T.StructType([f for f in df.schema if f.name != ORDER])

        def start(spec):
            first, *rest = spec if isinstance(spec, tuple) and spec else (spec,)
            if first == ():
                return F.struct(*[F.col(f"`{n}`") for n in kind.names]), kind
            head, _, tail = str(first).partition(".")
            if head not in kind.names:
                raise FieldError(f"no {head} in {', '.join(kind.names)}")
            return path(F.col(f"`{head}`"), kind[head].dataType, (*([tail] if tail else []), *rest))

        def typed(name, spec):
            c, found = start(spec)
            if T.VariantType() not in (found, A.leaf_type(found)):
                return c
            if self.missing == "error":
                c = F.when(c.isNull(), F.raise_error(F.lit(f"nothing at {spec}"))).otherwise(c)
            if name not in (self.types or {}):
                return c
            if isinstance(found, T.ArrayType):
                want = T._parse_datatype_string(self.types[name])
                return F.transform(c, lambda x: F.variant_get(x, "$", want.elementType.simpleString()))
            return F.variant_get(c, "$", self.types[name])

        return {name: typed(name, spec) for name, spec in self.spec_fields.items()}

    def outputs(self, df):
        return list(self.spec_fields)
