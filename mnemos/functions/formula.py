"""Formulas of views as Columns: Python's expressions over a row's fields, without evaluating any Python.

Python's own grammar reads a formula; each of its nodes becomes Columns for the value and for what went wrong. Names are a table's columns and have their types,
so what can't be (an unknown name, a call, an attribute, text times text) is an error before anything runs, and what depends on the row (nothing where a value is
needed, a division by zero, a missing key) is an error of that row.
"""

import ast
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.functions.columns import iso_time


class FormulaError(ValueError):
    """A formula that has no meaning for the given columns."""


class Value(NamedTuple):
    """A part of a formula. kind: int, float, bool, str, time, none, list or map; of: kinds of a list's values, or of a map's keys and values; error: null where all is well."""

    column: Column
    kind: str
    error: Column | None = None
    of: tuple = ()


_SPARK = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", "time": "timestamp", "none": "void"}
_NUMBERS = ("int", "float", "bool")
_NOTHING = "nothing where a value is needed"


def _all(*errors: Column | None) -> Column | None:
    """The first error that there is."""
    some = [e for e in errors if e is not None]
    return F.coalesce(*some) if some else None


def _if(test: Column, text: str) -> Column:
    return F.when(test, F.lit(text))


def _kind(type_: T.DataType) -> tuple[str, tuple]:
    if isinstance(type_, T.IntegralType):
        return "int", ()
    if isinstance(type_, T.NumericType):
        return "float", ()
    for kind, of in (("bool", T.BooleanType), ("str", T.StringType), ("time", (T.TimestampType, T.TimestampNTZType, T.DateType)), ("none", T.NullType)):
        if isinstance(type_, of):
            return kind, ()
    if isinstance(type_, T.ArrayType):
        return "list", (_kind(type_.elementType),)
    if isinstance(type_, T.MapType):
        return "map", (_kind(type_.keyType), _kind(type_.valueType))
    raise FormulaError(f"a column of type {type_.simpleString()} can't be used")


def _as(v: Value, kind: str) -> Column:
    return v.column.cast(_SPARK[kind]) if kind in _SPARK and v.kind != kind else v.column


def _common(values: list[Value]) -> tuple[str, tuple]:
    """The kind that several values can share: numbers are wide if one is, nothing fits all."""
    kinds = {(v.kind, v.of) for v in values if v.kind != "none"}
    if len(kinds) <= 1:
        return kinds.pop() if kinds else ("none", ())
    if all(k in _NUMBERS for k, _ in kinds):
        return ("float" if ("float", ()) in kinds else "int"), ()
    raise FormulaError("values of different kinds: " + ", ".join(sorted(k for k, _ in kinds)))


def _true(v: Value) -> Column:
    """Whether a value counts as true: not zero, not empty, not nothing."""
    test = {"int": v.column != 0, "float": v.column != 0, "bool": v.column, "str": v.column != "", "time": v.column.isNotNull(), "none": F.lit(False)}.get(v.kind)
    return F.coalesce(F.size(v.column) > 0 if test is None else test, F.lit(False))


def _same(a: Value, b: Value) -> Column:
    if "none" in (a.kind, b.kind):
        return (b.column if a.kind == "none" else a.column).isNull() if a.kind != b.kind else F.lit(True)
    if a.kind in _NUMBERS and b.kind in _NUMBERS:
        wide = "float" if "float" in (a.kind, b.kind) else "int"
        return _as(a, wide).eqNullSafe(_as(b, wide))
    if a.kind == b.kind == "list":
        inner = lambda x: Value(x, *_of(a.of[0]))
        other = lambda x: Value(x, *_of(b.of[0]))
        pairs = F.zip_with(a.column, b.column, lambda x, y: _same(inner(x), other(y)))
        return F.coalesce((F.size(a.column) == F.size(b.column)) & F.forall(pairs, lambda x: x), F.lit(False))
    return a.column.eqNullSafe(b.column) if (a.kind, a.of) == (b.kind, b.of) and a.kind != "map" else F.lit(False)


def _of(kind: tuple) -> tuple:
    """The fields kind, error and of of a value of this kind."""
    return kind[0], None, kind[1]


def _ordered(op: ast.cmpop, a: Value, b: Value) -> Value:
    numbers = a.kind in _NUMBERS and b.kind in _NUMBERS
    if "none" in (a.kind, b.kind):
        return Value(F.lit(False), "bool", F.lit(_NOTHING))
    if not numbers and (a.kind != b.kind or a.kind not in ("str", "time")):
        raise FormulaError(f"{a.kind} and {b.kind} have no order")
    x, y = (_as(a, "float"), _as(b, "float")) if numbers and "float" in (a.kind, b.kind) else (_as(a, "int"), _as(b, "int")) if numbers else (a.column, b.column)
    test = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]
    return Value(test, "bool", _if(x.isNull() | y.isNull(), _NOTHING))


def _inside(a: Value, b: Value) -> Value:
    if b.kind == "list":
        return Value(F.exists(b.column, lambda x: _same(a, Value(x, *_of(b.of[0])))), "bool", _if(b.column.isNull(), _NOTHING))
    if b.kind == "str" and a.kind == "str":
        return Value(F.contains(b.column, a.column), "bool", _if(a.column.isNull() | b.column.isNull(), _NOTHING))
    if b.kind == "map":
        fits = a.kind == b.of[0][0]
        return Value(F.map_contains_key(b.column, a.column) if fits else F.lit(False), "bool", _if(b.column.isNull(), _NOTHING))
    raise FormulaError(f"{a.kind} can't be looked for in {b.kind}")


def _compared(op: ast.cmpop, a: Value, b: Value) -> Value:
    if isinstance(op, (ast.Eq, ast.NotEq)):
        return Value(_same(a, b) if isinstance(op, ast.Eq) else ~_same(a, b), "bool")
    if isinstance(op, (ast.In, ast.NotIn)):
        found = _inside(a, b)
        return found if isinstance(op, ast.In) else found._replace(column=~found.column)
    if isinstance(op, (ast.Lt, ast.LtE, ast.Gt, ast.GtE)):
        return _ordered(op, a, b)
    raise FormulaError(f"unsupported comparison: {type(op).__name__}")


def _rest(x: Column, y: Column) -> Column:
    """The remainder with the divisor's sign."""
    r = x % F.nullif(y, F.lit(0).cast("bigint"))
    return F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)


def _power(x: Column, n: int) -> Column:
    """A whole number's power, by squares; null if it is too large."""
    out, square = F.lit(1).cast("bigint"), x
    while n:
        out = F.try_multiply(out, square) if n & 1 else out
        n >>= 1
        square = F.try_multiply(square, square) if n else square
    return out


def _counted(op: ast.operator, a: Value, b: Value, exponent: int | None) -> Value:
    """Arithmetic of numbers as Python has it: whole numbers stay whole but for /, and remainders have the divisor's sign."""
    missing = _if(a.column.isNull() | b.column.isNull(), _NOTHING)
    whole = a.kind != "float" and b.kind != "float"
    x, y = (_as(a, "int"), _as(b, "int")) if whole else (_as(a, "float"), _as(b, "float"))
    zero = _if(y == 0, "division by zero")
    if isinstance(op, ast.Div):
        return Value(F.try_divide(x.cast("double"), y.cast("double")), "float", _all(missing, zero))
    if isinstance(op, ast.Mod):
        return Value(_rest(x, y), "int" if whole else "float", _all(missing, zero))
    if isinstance(op, ast.FloorDiv):
        rest = x - _rest(x, y)
        return Value(F.call_function("div", rest, F.nullif(y, F.lit(0).cast("bigint"))) if whole else F.rint(F.try_divide(rest, y)), "int" if whole else "float", _all(missing, zero))
    if isinstance(op, ast.Pow):
        if whole and exponent is not None and 0 <= exponent <= 64:
            out = _power(x, exponent)
            return Value(out, "int", _all(missing, _if(out.isNull(), "number too large")))
        base, up = x.cast("double"), y.cast("double")
        return Value(F.pow(base, up), "float", _all(missing, _if((base == 0) & (up < 0), "division by zero"), _if((base < 0) & (up != F.floor(up)), "no real power")))
    if whole:
        out = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[type(op)](x, y)
        return Value(out, "int", _all(missing, _if(out.isNull(), "number too large")))
    return Value({ast.Add: x + y, ast.Sub: x - y, ast.Mult: x * y}[type(op)], "float", missing)


class _Compiler:
    def __init__(self, schema: T.StructType, times: tuple):
        self.fields, self.times = {f.name: f.dataType for f in schema}, set(times)

    def of(self, node: ast.AST) -> Value:
        make = getattr(self, f"_{type(node).__name__}", None)
        if make is None:
            raise FormulaError(f"unsupported syntax: {type(node).__name__}")
        return make(node)

    def _Expression(self, node):
        return self.of(node.body)

    def _Constant(self, node):
        kind = {bool: "bool", int: "int", float: "float", str: "str", type(None): "none"}.get(type(node.value))
        if kind is None:
            raise FormulaError(f"unsupported value: {node.value!r}")
        if kind == "int" and not -(1 << 63) <= node.value < 1 << 63:
            raise FormulaError("number too large")
        return Value(F.lit(node.value).cast(_SPARK[kind]) if kind in ("int", "float") else F.lit(node.value), kind)

    def _Name(self, node):
        if node.id not in self.fields:
            raise FormulaError(f"unknown field: {node.id!r}")
        column, (kind, of) = F.col(f"`{node.id}`"), _kind(self.fields[node.id])
        if kind == "str" and node.id in self.times:
            time = iso_time(column)
            return Value(time, "time", _if(column.isNotNull() & time.isNull(), "not a time"))
        return Value(column.cast(_SPARK[kind]) if kind in ("int", "float", "time") else column, kind, None, of)

    def _List(self, node):
        parts = [self.of(x) for x in node.elts]
        kind, of = _common(parts)
        column = F.array(*(_as(p, kind) for p in parts)) if parts else F.array().cast("array<string>")
        return Value(column, "list", _all(*(p.error for p in parts)), ((kind if parts else "str", of),))

    _Tuple = _List

    def _Dict(self, node):
        if not node.keys or None in node.keys:
            raise FormulaError("a dict needs keys")
        keys, values = [self.of(k) for k in node.keys], [self.of(v) for v in node.values]
        key, value = _common(keys), _common(values)
        if key[0] in ("none", "list", "map"):
            raise FormulaError(f"{key[0]} can't be a key")
        entries = F.array(*(F.struct(_as(k, key[0]).alias("k"), _as(v, value[0]).alias("v")) for k, v in zip(keys, values, strict=True)))
        # Of equal keys the last stands, as in Python.
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, len(keys)), lambda x: x["k"] == e["k"]))
        return Value(F.map_from_entries(last), "map", _all(*(p.error for p in keys + values), *(_if(_as(k, key[0]).isNull(), _NOTHING) for k in keys)), (key, value))

    def _Subscript(self, node):
        if isinstance(node.slice, ast.Slice):
            raise FormulaError("slices can't be used")
        v, at = self.of(node.value), self.of(node.slice)
        missing = _all(v.error, at.error, _if(v.column.isNull() | at.column.isNull(), _NOTHING))
        if v.kind == "map" and at.kind == v.of[0][0]:
            kind, of = v.of[1]
            return Value(F.try_element_at(v.column, at.column), kind, _all(missing, _if(~F.map_contains_key(v.column, at.column), "no such key")), of)
        if v.kind in ("list", "str") and at.kind in ("int", "bool"):
            size, i = (F.size(v.column) if v.kind == "list" else F.length(v.column)), _as(at, "int")
            place = F.when(i < 0, i + size).otherwise(i).cast("int")
            kind, of = v.of[0] if v.kind == "list" else ("str", ())
            got = F.get(v.column, place) if v.kind == "list" else F.substring(v.column, place + 1, F.lit(1))
            return Value(got, kind, _all(missing, _if((place < 0) | (place >= size), "no such place")), of)
        raise FormulaError(f"{at.kind} is no place in {v.kind}")

    def _UnaryOp(self, node):
        v = self.of(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~_true(v), "bool", v.error)
        if v.kind not in _NUMBERS or not isinstance(node.op, (ast.USub, ast.UAdd)):
            raise FormulaError(f"unsupported sign of {v.kind}")
        x = v if v.kind == "float" else v._replace(column=_as(v, "int"), kind="int")
        return x._replace(column=-x.column if isinstance(node.op, ast.USub) else x.column, error=_all(v.error, _if(x.column.isNull(), _NOTHING)))

    def _BinOp(self, node):
        a, b = self.of(node.left), self.of(node.right)
        errors = _all(a.error, b.error)
        if "none" in (a.kind, b.kind):
            return Value(F.lit(None), "none", _all(errors, F.lit(_NOTHING)))
        if a.kind in _NUMBERS and b.kind in _NUMBERS:
            if not isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow)):
                raise FormulaError(f"unsupported operator: {type(node.op).__name__}")
            exponent = node.right.value if isinstance(node.right, ast.Constant) and type(node.right.value) is int else None
            out = _counted(node.op, a, b, exponent)
        elif isinstance(node.op, ast.Add) and a.kind == b.kind and a.kind in ("str", "list") and a.of == b.of:
            out = Value(F.concat(a.column, b.column), a.kind, _if(a.column.isNull() | b.column.isNull(), _NOTHING), a.of)
        elif isinstance(node.op, ast.Mult) and {a.kind, b.kind} == {"str", "int"}:
            text, times = (a, b) if a.kind == "str" else (b, a)
            out = Value(F.repeat(text.column, times.column.cast("int")), "str", _if(a.column.isNull() | b.column.isNull(), _NOTHING))
        else:
            raise FormulaError(f"{type(node.op).__name__} of {a.kind} and {b.kind}")
        return out._replace(error=_all(errors, out.error))

    def _BoolOp(self, node):
        parts = [self.of(v) for v in node.values]
        join = (lambda x, y: x & y) if isinstance(node.op, ast.And) else (lambda x, y: x | y)
        return Value(reduce(join, map(_true, parts)), "bool", _all(*(p.error for p in parts)))

    def _Compare(self, node):
        """a < b < c: later parts only count, and only go wrong, where the earlier ones hold."""
        left = self.of(node.left)
        holds, error = F.lit(True), left.error
        for op, x in zip(node.ops, node.comparators, strict=True):
            right = self.of(x)
            step = _compared(op, left, right)
            wrong = _all(right.error, step.error)
            error = error if wrong is None else _all(error, F.when(holds, wrong))
            holds, left = holds & F.coalesce(step.column, F.lit(False)), right
        return Value(holds, "bool", error)

    def _IfExp(self, node):
        test, a, b = self.of(node.test), self.of(node.body), self.of(node.orelse)
        kind, of = _common([a, b])
        none = F.lit(None).cast("string")
        chosen = F.when(_true(test), none if a.error is None else a.error).otherwise(none if b.error is None else b.error)
        return Value(F.when(_true(test), _as(a, kind)).otherwise(_as(b, kind)), kind, _all(test.error, chosen), of)

    def _Call(self, node):
        if not isinstance(node.func, ast.Name) or node.func.id != "len" or len(node.args) != 1 or node.keywords:
            raise FormulaError("only len of one value can be called")
        v = self.of(node.args[0])
        if v.kind not in ("str", "list", "map"):
            raise FormulaError(f"{v.kind} has no length")
        return Value((F.length(v.column) if v.kind == "str" else F.size(v.column)).cast("bigint"), "int", _all(v.error, _if(v.column.isNull(), _NOTHING)))


def compiled(formula: str, schema: T.StructType, times: tuple = ()) -> tuple[Column, Column]:
    """The value of a formula, null where it goes wrong, and what went wrong there, else null.

    schema: whose fields the formula's names are. times: text fields that hold ISO times, which compare as times. Raises FormulaError for formulas that can't be. A
    null field is None: it equals None alone, is false, and has no arithmetic and no order.
    """
    try:
        tree = ast.parse(formula.strip(), mode="eval")
    except (SyntaxError, ValueError) as e:
        raise FormulaError("invalid syntax") from e
    v = _Compiler(schema, times).of(tree)
    error = F.lit(None).cast("string") if v.error is None else v.error
    return F.when(error.isNull(), v.column), error


def with_formulas(rows: DataFrame, formulas: dict[str, str], times: tuple = ()) -> DataFrame:
    """rows with a column for each formula and one for its error, named NAME_error; a later formula doesn't see an earlier one."""
    made = {name: compiled(text, rows.schema, times) for name, text in formulas.items()}
    return rows.withColumns({k: c for name, (value, error) in made.items() for k, c in ((name, value), (f"{name}_error", error))})
