"""Operators and pipelines: immutable descriptions that turn a DataFrame into a DataFrame.

Kinds: P adds or replaces columns row by row, F drops rows, G makes several rows of one, B folds consecutive rows, S numbers them. Rows
have no order in Spark: where a B or S operator follows, the pipeline carries a hidden order column, from order_by or else from the
order of the files, and those operators make it dense.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import json
import types
from collections.abc import Callable
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import numbered

ORDER = "__ord"


def described(value: Any, seen: tuple[int, ...] = ()) -> Any:
    """value as JSON data that is the same in every process: functions by code, constants, defaults, closure and the globals that they name; other objects by class and attributes."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return [type(value).__name__, repr(value)]
    if isinstance(value, bytes):
        return ["bytes", hashlib.sha256(value).hexdigest()]
    if id(value) in seen:
        return ["again", seen.index(id(value))]
    inner = functools.partial(described, seen=(*seen, id(value)))
    if isinstance(value, (list, tuple)):
        return [type(value).__name__, [inner(v) for v in value]]
    if isinstance(value, (set, frozenset)):
        return [type(value).__name__, sorted((inner(v) for v in value), key=json.dumps)]
    if isinstance(value, dict):
        return ["dict", [[inner(k), inner(v)] for k, v in value.items()]]
    if isinstance(value, types.CodeType):
        return ["code", value.co_code.hex(), inner(value.co_consts), value.co_names, value.co_varnames, value.co_flags]
    if isinstance(value, types.FunctionType):
        cells = [inner(c.cell_contents) for c in value.__closure__ or ()]
        used = sorted(_names(value.__code__) & value.__globals__.keys())
        return ["function", inner(value.__code__), inner(value.__defaults__), inner(value.__kwdefaults__), cells, [[n, inner(value.__globals__[n])] for n in used]]
    if isinstance(value, types.MethodType):
        return ["method", inner(value.__func__), inner(value.__self__)]
    if isinstance(value, types.ModuleType):
        return ["module", value.__name__]
    if isinstance(value, functools.partial):
        return ["partial", inner(value.func), inner(value.args), inner(value.keywords)]
    if isinstance(value, type):
        own = value.__module__ in ("__main__", "builtins") or not hasattr(value, "__dict__")
        body = {k: v for k, v in vars(value).items() if isinstance(v, (types.FunctionType, int, str, float, tuple))} if own and value.__module__ == "__main__" else {}
        return ["class", value.__module__, value.__qualname__, inner(dict(sorted(body.items())))]
    if isinstance(value, types.BuiltinFunctionType):
        return ["builtin", value.__module__, value.__qualname__]
    if dataclasses.is_dataclass(value):
        return ["data", inner(type(value)), [[f.name, inner(getattr(value, f.name))] for f in dataclasses.fields(value)]]
    call = getattr(type(value), "__call__", None)
    state = getattr(value, "__dict__", None)
    if state is None and " at 0x" not in repr(value):
        state = repr(value)
    if state is None:
        state = value.__reduce_ex__(4)[1:]
    return ["object", inner(type(value)), inner(call) if isinstance(call, types.FunctionType) else None, inner(state)]


def _names(code: types.CodeType) -> set[str]:
    """Names that a function's code and the functions in it look up."""
    return set(code.co_names).union(*(_names(c) for c in code.co_consts if isinstance(c, types.CodeType)))


class FieldError(ValueError):
    """A field that an operator needs or promises isn't there."""


@dataclasses.dataclass(frozen=True, eq=False, repr=False)
class Operator:
    kind: ClassVar[str] = "P"

    def inputs(self) -> tuple[str, ...]:
        return ()

    def columns(self, df: DataFrame) -> dict[str, Column]:
        """What a P operator computes."""
        return {}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns(df))

    def outputs(self, df: DataFrame) -> list[str]:
        """Fields left if the others are removed; df is the result."""
        return sorted(self.columns(df))

    def apply(self, df: DataFrame, remove_columns: bool = False) -> DataFrame:
        missing = [c for c in self.inputs() if c not in df.columns]
        if missing:
            raise FieldError(f"{self.name} needs {', '.join(missing)}; there are {', '.join(df.columns)}")
        promised = self.outputs(df) if remove_columns and self.kind == "P" else None
        out = self.transform(df)
        if remove_columns:
            keep = promised if promised is not None else self.outputs(out)
            out = out.select(*[c for c in out.columns if c in keep or c == ORDER])
        return out

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def fingerprint(self) -> str:
        """Stable over processes: of the class and its settings; functions count by what they do, not by where they are."""
        fields = {f.name: described(getattr(self, f.name)) for f in dataclasses.fields(self)}
        return hashlib.sha1(json.dumps([self.name, fields], sort_keys=True).encode()).hexdigest()

    def __eq__(self, other: object) -> bool:
        return Pipeline(self) == other if isinstance(other, Pipeline) else isinstance(other, Operator) and self.fingerprint == other.fingerprint

    def __hash__(self) -> int:
        return hash(self.fingerprint)

    def __repr__(self) -> str:
        return f"{self.name}({self.fingerprint[:6]})"

    def __rshift__(self, other: Operator | Pipeline) -> Pipeline:
        return Pipeline(self) >> other

    def __lshift__(self, other: Operator | Pipeline) -> Pipeline:
        return Pipeline(other) >> self

    chain = __rshift__

    def map(self, df: DataFrame, **options: Any) -> DataFrame:
        return Pipeline(self).map(df, **options)


class Pipeline:
    """Operators applied one after another; >> and << make new pipelines and change none."""

    def __init__(self, *parts: Operator | Pipeline):
        self.operators: tuple[Operator, ...] = tuple(o for p in parts for o in (p.operators if isinstance(p, Pipeline) else (p,)))
        if not self.operators:
            raise ValueError("a pipeline needs an operator")

    def __rshift__(self, other: Operator | Pipeline) -> Pipeline:
        return Pipeline(self, other)

    def __lshift__(self, other: Operator | Pipeline) -> Pipeline:
        return Pipeline(other, self)

    chain = __rshift__

    def __getitem__(self, at: int) -> Operator:
        return self.operators[at]

    def __len__(self) -> int:
        return len(self.operators)

    def __eq__(self, other: object) -> bool:
        return self.operators == (other.operators if isinstance(other, Pipeline) else (other,))

    def __hash__(self) -> int:
        return hash(self.operators)

    def __repr__(self) -> str:
        return " >> ".join(map(repr, self.operators))

    @property
    def fingerprint(self) -> str:
        return hashlib.sha1("".join(o.fingerprint for o in self.operators).encode()).hexdigest()

    def map(self, df: DataFrame, order_by: list[str] | None = None, remove_columns: bool = False, watch: Callable[[int, DataFrame], DataFrame] = lambda _, df: df) -> DataFrame:
        """The operators in turn; watch(number, result) gets what goes in (-1) and what each gives, and returns what to go on with (see plans.counts)."""
        from ..operators.cache import run_segments

        ordered = any(o.kind in "BS" for o in self.operators)
        if ordered and df.isStreaming:
            raise ValueError("operators that depend on the order of rows run on streams through seqprep.streaming")
        if ordered and ORDER not in df.columns:
            df = numbered(df, [F.col(c) for c in order_by], ORDER) if order_by else df.withColumn(ORDER, F.monotonically_increasing_id())
            df = df.withColumn(ORDER, F.array(ORDER))
        return run_segments(self.operators, watch(-1, df), remove_columns, watch).drop(ORDER)

    apply = map

    def one(self, spark: SparkSession, schema: str, **sample: Any) -> dict[str, Any]:
        """The one result of one sample."""
        names = [x.split()[0].strip("`") for x in schema.split(",")] if "<" not in schema else list(sample)
        rows = self.map(spark.createDataFrame([tuple(sample[c] for c in names)], schema)).take(2)
        if len(rows) != 1:
            raise ValueError(f"one sample gave {len(rows)} results")
        return rows[0].asDict(recursive=True)


def make_pipeline(first: Operator | Pipeline, *rest: Operator | Pipeline) -> Pipeline:
    return Pipeline(first, *rest)


def dense(df: DataFrame) -> DataFrame:
    """df with the hidden order made 0, 1, 2, ... (a long)."""
    return numbered(df.withColumnRenamed(ORDER, "_old"), [F.col("_old")], ORDER).drop("_old")


def extended(df: DataFrame, position: str) -> DataFrame:
    """After a G operator: order by the row, then by the position in it."""
    return (df.withColumn(ORDER, F.concat(ORDER, F.array(F.col(position).cast("long")))) if ORDER in df.columns else df).drop(position)
