"""Column builders with Python's sequence semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def size_of(c: Column, kind: T.DataType) -> Column:
    return F.length(c) if isinstance(kind, T.StringType) else F.size(c)


def upto(n: Column) -> Column:
    """[0, 1, ..., n - 1]."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)


def cut(c: Column, kind: T.DataType, start: Column, count: Column) -> Column:
    """c[start : start + count] of an array or a string; start >= 0."""
    count = F.greatest(count, F.lit(0))
    return F.substring(c, start + 1, count) if isinstance(kind, T.StringType) else F.slice(c, start + 1, count)


def head(c: Column, kind: T.DataType, n: Column) -> Column:
    """c[:n]; a negative n drops from the end."""
    return cut(c, kind, F.lit(0), F.when(n < 0, size_of(c, kind) + n).otherwise(n))


def leaves(c: Column, kind: T.DataType, leaf: Callable[[Column, T.DataType], Column]) -> Column:
    """leaf applied to every value below arrays, structs and maps."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: leaves(x, kind.elementType, leaf))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[leaves(c[f.name], f.dataType, leaf).alias(f.name) for f in kind]))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: leaves(v, kind.valueType, leaf))
    return leaf(c, kind)


def every(c: Column, kind: T.DataType, test: Callable[[Column, T.DataType], Column]) -> Column:
    """True if test holds for every leaf (so for an empty list); unknown counts as false."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(c, lambda x: every(x, kind.elementType, test)), F.lit(False))
    if isinstance(kind, T.StructType):
        out = F.lit(True)
        for f in kind:
            out = out & every(c[f.name], f.dataType, test)
        return out
    if isinstance(kind, T.MapType):
        return F.coalesce(F.forall(F.map_values(c), lambda x: every(x, kind.valueType, test)), F.lit(False))
    return F.coalesce(test(c, kind), F.lit(False))


def leaf_type(kind: T.DataType) -> T.DataType:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def depth(kind: T.DataType) -> int:
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def flat(c: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """All levels of lists made one."""
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    return c, kind


def flat_with_sizes(c: Column, kind: T.DataType) -> tuple[Column, list[Column]]:
    """(all levels of lists made one, sizes of the lists of each level below the first, outermost first): what nested_again() undoes."""
    sizes = []
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        sizes.append(F.transform(c, F.size))
        c, kind = F.flatten(c), kind.elementType
    return c, sizes


def nested_again(c: Column, sizes: list[Column]) -> Column:
    """The nested list whose flat form and sizes are given."""
    def cut(c: Column, n: Column) -> Column:
        return F.transform(n, lambda k, i: F.slice(c, before(n, i) + 1, k))

    for n in reversed(sizes):
        c = cut(c, n)
    return c


def filled(value: Column, count: Column) -> Column:
    return F.array_repeat(value, F.greatest(count, F.lit(0)).cast("int"))


def fail_if(bad: Column, message: str, c: Column) -> Column:
    """c, or an error where bad holds."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(c)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is evaluated once a row although use names it in a loop: Spark puts an expression that is named once in place of its name, loops too."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def before(sizes: Column, i: Column) -> Column:
    """Sum of the first i sizes."""
    return F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x)


def matches_python_truth(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.length(c) > 0
    return c if isinstance(kind, T.BooleanType) else c != 0
