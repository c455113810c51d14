"""A bounded template language compiled to Columns.

Text, {{ value }}, {% for x in list %}, {% if %} / {% elif %} / {% else %}, {% set x = value %}, {% macro f(a, b=value) %}, comments {# #}, and white space
control with -. Values are literals, lists, paths (a.b, a[0], a["b"], a[i]), slices, loop.index, loop.index0, loop.first, loop.last, loop.length,
x if test else y, comparisons, and / or / not, +, range(), calls of macros, the methods upper lower strip split join replace startswith endswith of texts, and
filters: length join lower upper trim default replace first last. Anything else is an error when the template is compiled. Undefined names print as nothing.

A set holds to the end of its scope: a loop's body (for one round) or a macro is one, a branch isn't, so names set in branches have the value of the branch taken. Macros are
compiled where they are called, with the names known where they are defined; none calls itself.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import ORDER, Operator, dense

_TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#-?.*?-?#\})", re.S)
SHOTS = "__shots__"


class TemplateError(ValueError):
    pass


@dataclass
class _Node:
    kind: str
    value: Any = None
    parts: list = field(default_factory=list)


def parse(template: str) -> list[_Node]:
    pieces = _TAGS.split(template)
    for k, p in enumerate(pieces):
        if k % 2:
            if p[2] == "-":
                pieces[k - 1] = pieces[k - 1].rstrip()
            if p[-3] == "-":
                pieces[k + 1] = pieces[k + 1].lstrip()
    root = _Node("root")
    open_: list[tuple[str, list]] = [("root", root.parts)]
    ifs: list[_Node] = []
    for k, p in enumerate(pieces):
        into = open_[-1][1]
        if k % 2 == 0:
            if p:
                into.append(_Node("text", p))
            continue
        body = p[2:-2].strip("-").strip()
        if p[1] == "#":
            continue
        if p[1] == "{":
            into.append(_Node("print", body))
            continue
        word, _, rest = body.partition(" ")
        if word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip())
            if not m:
                raise TemplateError(body)
            into.append(_Node("for", (m[1], m[2])))
            open_.append(("for", into[-1].parts))
        elif word == "set":
            m = re.fullmatch(r"(\w+)\s*=(?!=)\s*(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(body)
            into.append(_Node("set", (m[1], m[2])))
        elif word == "macro":
            m = re.fullmatch(r"(\w+)\s*\((.*)\)", rest.strip(), re.S)
            if not m:
                raise TemplateError(body)
            into.append(_Node("macro", (m[1], _parsed(f"lambda {m[2]}: 0").args)))
            open_.append(("macro", into[-1].parts))
        elif word == "if":
            node = _Node("if", [(rest, [])])
            into.append(node)
            open_.append(("if", node.value[-1][1]))
            ifs.append(node)
        elif word in ("elif", "else") and open_[-1][0] == "if":
            node = ifs[-1]
            node.value.append((rest if word == "elif" else None, []))
            open_[-1] = ("if", node.value[-1][1])
        elif word in ("endfor", "endif", "endmacro") and open_[-1][0] == word[3:]:
            if word == "endif":
                ifs.pop()
            open_.pop()
        else:
            raise TemplateError(f"unsupported: {p}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} isn't closed")
    return root.parts


_Typed = tuple[Column, T.DataType]
_S = T.StringType()


@dataclass(frozen=True)
class _Macro:
    """Parameters with their defaults, body, and the names known where it is defined."""

    parameters: tuple[tuple[str, ast.expr | None], ...]
    parts: list
    names: dict


def _parsed(text: str) -> ast.expr:
    """A value's text as a tree. The filter mark is Python's |, which binds tighter than comparisons as filters do; an if without else gives nothing."""
    for t in (text.strip(), f"{text.strip()} else undefined"):
        try:
            return ast.parse(t, mode="eval").body
        except SyntaxError:
            continue
    raise TemplateError(text)


def _value(text: str, names: dict[str, Any]) -> _Typed | None:
    """The value of an expression with filters; None if undefined."""
    return _expression(_parsed(text), names)


def _number(e: ast.expr, names) -> Column:
    got = _expression(e, names)
    if got is None or not isinstance(got[1], T.IntegralType):
        raise TemplateError(f"{ast.unparse(e)} isn't a whole number")
    return got[0].cast("int")


def _item(base: _Typed, e: ast.expr, names) -> _Typed | None:
    """base[e]."""
    c, kind = base
    if isinstance(e, ast.Slice):
        if e.step is not None or not isinstance(kind, (T.ArrayType, T.StringType)):
            raise TemplateError(f"unsupported slice {ast.unparse(e)}")
        n = A.size_of(c, kind)
        bound = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(x)
        low = F.lit(0) if e.lower is None else bound(_number(e.lower, names))
        return A.cut(c, kind, low, (n if e.upper is None else F.least(bound(_number(e.upper, names)), n)) - low), kind
    try:
        key = ast.literal_eval(e)
    except ValueError:
        key = None
    if key is None:
        if isinstance(kind, T.ArrayType):
            k = _number(e, names)
            return F.try_element_at(c, F.when(k < 0, k).otherwise(k + 1)), kind.elementType
        got = _expression(e, names)
        if isinstance(kind, T.MapType) and got is not None:
            return F.try_element_at(c, got[0]), kind.valueType
        raise TemplateError(f"unsupported: [{ast.unparse(e)}]")
    if isinstance(kind, T.StructType):
        return (c.getField(key), kind[key].dataType) if key in kind.names else None
    if isinstance(kind, T.MapType):
        return F.try_element_at(c, F.lit(key)), kind.valueType
    if isinstance(kind, T.ArrayType) and isinstance(key, int):
        return F.try_element_at(c, F.lit(key + 1 if key >= 0 else key)), kind.elementType
    return None


def _same(values: list[_Typed]) -> tuple[list[Column], T.DataType]:
    """Values made one type: that of the first, or the wider of two kinds of numbers."""
    kind = values[0][1]
    for _, k in values[1:]:
        if k != kind:
            if not isinstance(k, T.NumericType) or not isinstance(kind, T.NumericType):
                raise TemplateError(f"{kind.simpleString()} and {k.simpleString()} in one place")
            kind = T.LongType() if isinstance(k, T.IntegralType) and isinstance(kind, T.IntegralType) else T.DoubleType()
    return [c.cast(kind) for c, _ in values], kind


def _expression(e: ast.expr, names: dict[str, Any]) -> _Typed | None:
    if isinstance(e, ast.Constant):
        kind = {str: _S, bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(e.value))
        if kind is None:
            raise TemplateError(ast.unparse(e))
        return F.lit(e.value), kind
    if isinstance(e, ast.Name):
        if e.id in ("true", "false") and e.id not in names:
            return F.lit(e.id == "true"), T.BooleanType()
        got = names.get(e.id)
        if isinstance(got, _Macro):
            raise TemplateError(f"{e.id} is a macro")
        return got
    if isinstance(e, (ast.List, ast.Tuple)):
        parts = [_expression(x, names) for x in e.elts]
        if not parts or None in parts:
            raise TemplateError(f"unsupported: {ast.unparse(e)}")
        found, kind = _same(parts)
        return F.array(*found), T.ArrayType(kind)
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub) and isinstance(e.operand, ast.Constant):
        return F.lit(-e.operand.value), T.LongType() if isinstance(e.operand.value, int) else T.DoubleType()
    if isinstance(e, ast.Attribute) and isinstance(e.value, ast.Name) and e.value.id == "loop":
        return names.get(f"loop.{e.attr}")
    if isinstance(e, (ast.Attribute, ast.Subscript)):
        base = _expression(e.value, names)
        if base is None:
            return None
        return _item(base, ast.Constant(e.attr) if isinstance(e, ast.Attribute) else e.slice, names)
    if isinstance(e, ast.IfExp):
        test, values = truth(_expression(e.test, names)), [_expression(x, names) for x in (e.body, e.orelse)]
        known = [v for v in values if v is not None]
        if not known:
            return None
        found, kind = _same(known) if len({v[1] for v in known}) == 1 or all(isinstance(v[1], T.NumericType) for v in known) else ([shown(v) for v in known], _S)
        found = iter(found)
        a, b = (next(found) if v is not None else F.lit(None).cast(kind) for v in values)
        return F.when(test, a).otherwise(b), kind
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.BitOr):
        if isinstance(e.left, ast.BinOp) and not isinstance(e.left.op, ast.BitOr):
            raise TemplateError(f"a filter of a sum: {ast.unparse(e)}")
        if isinstance(e.right, ast.Name):
            return _filter(e.right.id, [], _expression(e.left, names))
        if isinstance(e.right, ast.Call) and isinstance(e.right.func, ast.Name) and not e.right.keywords:
            return _filter(e.right.func.id, [_expression(x, names) for x in e.right.args], _expression(e.left, names))
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
        a, b = _expression(e.left, names), _expression(e.right, names)
        if a is not None and b is not None:
            if all(isinstance(x[1], T.NumericType) for x in (a, b)):
                (x, y), kind = _same([a, b])
                return x + y, kind
            if a[1] == b[1] and isinstance(a[1], (T.StringType, T.ArrayType)):
                return F.concat(a[0], b[0]), a[1]
    if isinstance(e, ast.Call):
        return _call(e, names)
    if isinstance(e, ast.BoolOp):
        parts = [truth(_expression(x, names)) for x in e.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(e.op, ast.And) else out | p
        return out, T.BooleanType()
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
        return ~truth(_expression(e.operand, names)), T.BooleanType()
    if isinstance(e, ast.Compare) and len(e.ops) == 1:
        a, b = _expression(e.left, names), _expression(e.comparators[0], names)
        if a is None or b is None:
            return F.lit(isinstance(e.ops[0], ast.NotEq)), T.BooleanType()
        op, x, y = type(e.ops[0]), a[0], b[0]
        if op in (ast.In, ast.NotIn):
            found = F.coalesce(F.array_contains(y, x) if isinstance(b[1], T.ArrayType) else F.contains(y, x), F.lit(False))
            return (found if op is ast.In else ~found), T.BooleanType()
        made = {ast.Eq: lambda: x.eqNullSafe(y), ast.NotEq: lambda: ~x.eqNullSafe(y), ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y}.get(op)
        if made:
            return F.coalesce(made(), F.lit(False)), T.BooleanType()
    raise TemplateError(f"unsupported: {ast.unparse(e)}")


def _call(e: ast.Call, names: dict[str, Any]) -> _Typed | None:
    """range, a macro, or a method of a text."""
    if isinstance(e.func, ast.Name) and isinstance(names.get(e.func.id), _Macro):
        return _expanded(e, names)
    if isinstance(e.func, ast.Name) and e.func.id == "range" and 1 <= len(e.args) <= 3 and not e.keywords:
        given = [_number(x, names) for x in e.args]
        start, stop = (F.lit(0), given[0]) if len(given) == 1 else given[:2]
        step = given[2] if len(given) == 3 else F.lit(1)
        return F.transform(A.upto(F.ceil((stop - start) / step).cast("int")), lambda i: (start + i * step).cast("long")), T.ArrayType(T.LongType())
    if isinstance(e.func, ast.Attribute) and not e.keywords:
        base = _expression(e.func.value, names)
        if base is None:
            return None
        args, name = [_expression(x, names) for x in e.args], e.func.attr
        if isinstance(base[1], T.StringType) and None not in args:
            c, text = base[0], [a for a, _ in args]
            counts = {"upper": 0, "lower": 0, "strip": 0, "replace": 2, "startswith": 1, "endswith": 1, "split": 1, "join": 1}
            if counts.get(name) == len(args):
                made = {"upper": lambda: F.upper(c), "lower": lambda: F.lower(c), "strip": lambda: strip(c), "replace": lambda: F.replace(c, *text), "startswith": lambda: F.startswith(c, *text), "endswith": lambda: F.endswith(c, *text), "split": lambda: F.split(c, F.concat(F.lit("\\Q"), *text, F.lit("\\E"))), "join": lambda: _join(args[0], c)}[name]()
                return made, {"startswith": T.BooleanType(), "endswith": T.BooleanType(), "split": T.ArrayType(_S)}.get(name, _S)
            if name == "split" and not args:
                return F.filter(F.split(strip(c), r"(?U)\s+"), lambda x: F.length(x) > 0), T.ArrayType(_S)
    raise TemplateError(f"unsupported: {ast.unparse(e)}")


def _expanded(e: ast.Call, names: dict[str, Any]) -> _Typed:
    macro = names[e.func.id]
    given = dict(zip([p for p, _ in macro.parameters], e.args, strict=False)) | {k.arg: k.value for k in e.keywords}
    if len(e.args) > len(macro.parameters) or set(given) - {p for p, _ in macro.parameters}:
        raise TemplateError(f"arguments of {ast.unparse(e)}")
    inner = dict(macro.names)
    for p, default in macro.parameters:
        inner[p] = _expression(given[p], names) if p in given else _expression(default, macro.names) if default is not None else None
    return render(macro.parts, inner), _S


def truth(v: _Typed | None) -> Column:
    if v is None:
        return F.lit(False)
    c, kind = v
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() if isinstance(kind, T.StructType) else F.coalesce(A.matches_python_truth(c, kind), F.lit(False))


def shown(v: _Typed | None) -> Column:
    if v is None:
        return F.lit("")
    c, kind = v
    if isinstance(kind, T.BooleanType):
        c = F.initcap(c.cast("string"))
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def _filter(name: str, args: list[_Typed | None], v: _Typed | None) -> _Typed | None:
    if name == "default":
        return args[0] if v is None else (F.coalesce(v[0], args[0][0].cast(v[1])), v[1])
    if name == "length":
        return (F.lit(0), T.IntegerType()) if v is None else (A.size_of(*v), T.IntegerType())
    if v is None:
        return None
    if name == "join":
        return _join(v, args[0][0] if args else F.lit("")), _S
    if name in ("lower", "upper"):
        return getattr(F, name)(shown(v)), _S
    if name == "trim":
        return strip(shown(v)), _S
    if name == "replace":
        return F.replace(shown(v), args[0][0], args[1][0]), _S
    if name in ("first", "last"):
        return F.try_element_at(v[0], F.lit(1 if name == "first" else -1)), v[1].elementType
    raise TemplateError(f"unsupported filter {name}")


def _join(v: _Typed, mark: Column) -> Column:
    shown_ = F.transform(v[0], lambda x: shown((x, v[1].elementType)))
    return F.aggregate(F.transform(shown_, lambda x, i: F.when(i == 0, x).otherwise(F.concat(mark, x))), F.lit(""), lambda a, x: F.concat(a, x))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def render(nodes: list[_Node], names: dict[str, Any]) -> Column:
    """The text of nodes; names is their scope, to which their sets are added."""
    parts: list[Column] = []
    for n in nodes:
        if n.kind == "text":
            parts.append(F.lit(n.value))
        elif n.kind == "print":
            parts.append(shown(_value(n.value, names)))
        elif n.kind == "if":
            out, found = F.lit(""), []
            for test, body in n.value:
                inner = dict(names)
                found.append((None if test is None else truth(_value(test, names)), inner, render(body, inner)))
            for test, _, made in reversed(found):
                out = made if test is None else F.when(test, made).otherwise(out)
            parts.append(out)
            for name in sorted({k for _, inner, _ in found for k in inner if inner[k] is not names.get(k)}):
                names[name] = _merged(name, names.get(name), [(test, inner.get(name)) for test, inner, _ in found])
        elif n.kind == "set":
            names[n.value[0]] = _value(n.value[1], names)
        elif n.kind == "macro":
            given = n.value[1]
            if given.vararg or given.kwarg or given.kwonlyargs or given.posonlyargs:
                raise TemplateError(f"parameters of {n.value[0]}")
            defaults = [None] * (len(given.args) - len(given.defaults)) + given.defaults
            names[n.value[0]] = _Macro(tuple((a.arg, d) for a, d in zip(given.args, defaults, strict=True)), n.parts, dict(names))
        else:
            over = _value(n.value[1], names)
            if over is None:
                continue
            if not isinstance(over[1], T.ArrayType):
                raise TemplateError(f"{n.value[1]} isn't a list")

            parts.append(_loop(n, over, names))
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")


def _merged(name: str, old: _Typed | None, branches: list[tuple[Column | None, _Typed | None]]) -> _Typed | None:
    """A name after branches: its value in the one taken, as it was if none is."""
    known = [v for v in (old, *[v for _, v in branches]) if v is not None]
    if any(isinstance(v, _Macro) for v in known):
        raise TemplateError(f"macro {name} in a branch")
    if not known:
        return None
    same = len({v[1] for v in known}) == 1 or all(isinstance(v[1], T.NumericType) for v in known)
    kind = _same(known)[1] if same else _S
    of = lambda v: F.lit(None).cast(kind) if v is None else v[0].cast(kind) if same else shown(v)
    out = of(old)
    for test, v in reversed(branches):
        out = of(v) if test is None else F.when(test, of(v)).otherwise(out)
    return out, kind


def _loop(n: _Node, over: _Typed, names: dict[str, _Typed]) -> Column:
    c, kind = over

    def body(x, i):
        loop = {"loop.index": (i + 1, T.IntegerType()), "loop.index0": (i, T.IntegerType()), "loop.first": (i == 0, T.BooleanType()), "loop.last": (i == F.size(c) - 1, T.BooleanType()), "loop.length": (F.size(c), T.IntegerType())}
        return render(n.parts, names | loop | {n.value[0]: (x, kind.elementType)})

    return F.coalesce(F.array_join(F.transform(c, body), ""), F.lit(""))


def _free(e: ast.AST) -> set[str]:
    """Names in an expression but those of filters and functions."""
    if isinstance(e, ast.Name):
        return {e.id}
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.BitOr):
        return _free(e.left).union(*(_free(x) for x in getattr(e.right, "args", ())))
    if isinstance(e, ast.Call) and isinstance(e.func, ast.Name):
        return set().union(*(_free(x) for x in (*e.args, *e.keywords)))
    return set().union(*(_free(x) for x in ast.iter_child_nodes(e)))


def variables(nodes: list[_Node], bound: frozenset[str] = frozenset({"loop", "true", "false", "none", "undefined"})) -> set[str]:
    """Names that a template takes from the data. A name set before, be it in one branch, isn't one."""
    out: set[str] = set()
    seen = set(bound)
    for n in nodes:
        if n.kind == "print":
            out |= _free(_parsed(n.value)) - seen
        elif n.kind == "set":
            out |= _free(_parsed(n.value[1])) - seen
            seen.add(n.value[0])
        elif n.kind == "macro":
            given = n.value[1]
            out |= set().union(*(_free(d) for d in given.defaults)) - seen
            out |= variables(n.parts, frozenset(seen | {a.arg for a in given.args}))
        elif n.kind == "if":
            for test, body in n.value:
                out |= (_free(_parsed(test)) - seen if test else set()) | variables(body, frozenset(seen))
            seen |= {x.value[0] for _, body in n.value for x in body if x.kind == "set"}
        elif n.kind == "for":
            out |= (_free(_parsed(n.value[1])) - seen) | variables(n.parts, frozenset(seen | {n.value[0]}))
    return out


def template_text(template: str) -> str:
    """The template without its tags."""
    return _TAGS.sub("", template)


def fragments(template: str) -> list[str]:
    return [x.strip() for x in template.split("|||")]


def has_target(template: str) -> bool:
    return "|||" in template


def input_fields(template: str) -> dict[str, list[str]]:
    """Fields of each fragment: source, target."""
    found = [sorted(variables(parse(f))) for f in fragments(template)]
    return {"source": found[0], "target": sorted({v for f in found[1:] for v in f})}


@dataclass(frozen=True, eq=False, repr=False)
class Jinja(Operator):
    """Render a template, split it at |||, strip the parts: the first is the source, the rest the target (a list if several are allowed)."""

    jinja: str
    source_field_name: str = "source"
    target_field_name: str = "target"
    return_multiple_targets: bool = False
    extra_variables: dict[str, Any] | None = None

    def __post_init__(self):
        parse(self.jinja)
        if len(fragments(self.jinja)) > 2 and not self.return_multiple_targets:
            raise ValueError("several targets; set return_multiple_targets")

    def names(self, df) -> dict[str, _Typed]:
        out = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema if f.name != ORDER}
        for k, v in (self.extra_variables or {}).items():
            out[k] = F.lit(v), T.ArrayType(T._infer_type(v[0])) if isinstance(v, (list, tuple)) and v else T._infer_type(v)
        return out

    def columns(self, df):
        whole = render(parse(self.jinja), self.names(df))
        parts = F.transform(F.split(whole, r"\|\|\|"), strip)
        out = {self.source_field_name: F.element_at(parts, 1)}
        if has_target(self.jinja):
            if self.return_multiple_targets:
                out[self.target_field_name] = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
            else:
                out[self.target_field_name] = A.fail_if(F.size(parts) > 2, "several targets", F.element_at(parts, 2))
        return out

    def outputs(self, df):
        return [self.source_field_name, *([self.target_field_name] if has_target(self.jinja) else [])]


@dataclass(frozen=True, eq=False, repr=False)
class FewShotJinja(Jinja):
    """num_shots consecutive rows as __shots__ and the next as the sample; with keep_last the last of a rest is its sample. "max": all but the last are shots."""

    kind: ClassVar[str] = "B"
    num_shots: int | str = 0
    keep_last: bool = False

    def __post_init__(self):
        super().__post_init__()
        if self.num_shots != "max" and (not isinstance(self.num_shots, int) or self.num_shots < 0):
            raise ValueError("num_shots is 0 or more, or max")
        if SHOTS not in variables(parse(self.jinja)):
            raise KeyError(f"the template has no {SHOTS}")

    def transform(self, df):
        rows, names = dense(df), [c for c in df.columns if c != ORDER]
        k = None if self.num_shots == "max" else self.num_shots + 1
        group = F.lit(0).cast("long") if k is None else F.floor(F.col(ORDER) / k)
        out = rows.groupBy(group.alias("__g")).agg(F.sort_array(F.collect_list(F.struct(ORDER, F.struct(*names).alias("r")))).alias("__b"))
        if k is not None and not self.keep_last:
            out = out.where(F.size("__b") == k)
        query = F.element_at("__b", -1)["r"]
        out = out.select(F.array("__g").alias(ORDER), F.transform(F.slice("__b", 1, F.size("__b") - 1), lambda x: x["r"]).alias(SHOTS), *[query[c].alias(c) for c in names])
        return out.select(*[c.alias(n) for n, c in self.columns(out).items()], ORDER)


def registered(registry: dict[str, str], name: str, **options: Any) -> Jinja:
    """A template by name from a registry (a dict, or the contents of a JSON file)."""
    if name not in registry:
        raise KeyError(name)
    return Jinja(registry[name], **options)
