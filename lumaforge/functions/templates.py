"""Naming templates as Column expressions.

A template such as ``upper(<filename>)_<width*2>_###`` is turned into one Column on the driver, so that
rendering a corpus is a projection. ``<...>`` holds a variable or a Python-style expression,
``name(...)`` calls a listed function, and a run of three or more ``#`` becomes a counter format.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"(?P<fn>\w+)\((?P<args>[^)]*)\)|<(?P<expr>[^>]+)>|(?P<count>#{3,})")
KEYWORDS = ("if", "else", "and", "or", "not", "in", "is", "True", "False", "None")


class TemplateError(ValueError):
    """The template itself is wrong, whatever the row."""


@dataclass
class Value:
    """A Column with what is needed to print and check it."""

    col: Column
    dtype: T.DataType
    checks: list[tuple[Column, str]] = field(default_factory=list)

    @property
    def is_int(self) -> bool:
        return isinstance(self.dtype, T.IntegralType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.dtype, T.NumericType)

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    @property
    def is_list(self) -> bool:
        return isinstance(self.dtype, T.ArrayType)


TOO_LARGE = "number out of range"
LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def text_of(v: Value) -> Column:
    if isinstance(v.dtype, T.BooleanType):
        return F.when(v.col, "True").otherwise("False")
    if v.is_list:
        quote = isinstance(v.dtype.elementType, T.StringType)
        items = F.transform(v.col, lambda c: F.concat(F.lit("'"), c, F.lit("'")) if quote else c.cast("string"))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return F.coalesce(v.col.cast("string"), F.lit(""))


def _truth(v: Value) -> Column:
    if isinstance(v.dtype, T.BooleanType):
        out = v.col
    elif v.is_number:
        out = v.col != 0
    elif v.is_list:
        out = F.size(v.col) > 0
    else:
        out = v.col != ""
    return F.coalesce(out, F.lit(False))


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise TemplateError(message)


# --- functions ----------------------------------------------------------------------------------


def _string_fn(name: str, build):
    def run(args: list[Value]) -> Value:
        _need(len(args) >= 1 and args[0].is_text, f"Function '{name}' failed: needs a string")
        return Value(build(args[0].col), STRING)

    return run


def _replace(args: list[Value]) -> Value:
    _need(len(args) == 3 and all(a.is_text for a in args), "Function 'replace' failed: needs three strings")
    return Value(F.replace(args[0].col, args[1].col, args[2].col), STRING)


def _len(args: list[Value]) -> Value:
    _need(len(args) == 1 and (args[0].is_text or args[0].is_list), "Function 'len' failed: needs a string or list")
    a = args[0]
    return Value((F.size(a.col) if a.is_list else F.char_length(a.col)).cast("long"), LONG)


def _abs(args: list[Value]) -> Value:
    _need(len(args) == 1 and args[0].is_number, "Function 'abs' failed: needs a number")
    return Value(F.abs(args[0].col), args[0].dtype)


def _int(args: list[Value]) -> Value:
    _need(len(args) == 1, "Function 'int' failed: needs one argument")
    a = args[0]
    if a.is_text:
        text = F.trim(a.col)
        good = F.coalesce(text.rlike(r"^[+-]?[0-9]+$"), F.lit(False))
        return Value(F.when(good, text.try_cast("bigint")), LONG, [(~good, "Function 'int' failed")])
    if isinstance(a.dtype, T.BooleanType):
        return Value(a.col.cast("long"), LONG)
    return Value(F.when(a.col >= 0, F.floor(a.col)).otherwise(F.ceil(a.col)).cast("long"), LONG)


def _float(args: list[Value]) -> Value:
    _need(len(args) == 1, "Function 'float' failed: needs one argument")
    a = args[0]
    if a.is_text:
        value = F.trim(a.col).try_cast("double")
        return Value(value, DOUBLE, [(value.isNull(), "Function 'float' failed")])
    return Value(a.col.cast("double"), DOUBLE)


def _extreme(name: str, over_row, over_list):
    def run(args: list[Value]) -> Value:
        if len(args) == 1 and args[0].is_list:
            return Value(over_list(args[0].col), args[0].dtype.elementType)
        _need(len(args) >= 2, f"Function '{name}' failed: needs two values or a list")
        numbers, texts = all(a.is_number for a in args), all(a.is_text for a in args)
        _need(numbers or texts, f"Function '{name}' failed: values of different types")
        kind = STRING if texts else LONG if all(a.is_int for a in args) else DOUBLE
        return Value(over_row(*[a.col.cast(kind) for a in args]), kind)

    return run


def _round(args: list[Value]) -> Value:
    _need(len(args) in (1, 2) and args[0].is_number, "Function 'round' failed: needs a number")
    if len(args) == 1:
        whole = F.bround(args[0].col.cast("double"), 0).try_cast("bigint")
        return Value(whole, LONG, [(args[0].col.isNotNull() & whole.isNull(), TOO_LARGE)])
    digits = getattr(args[1], "constant", None)
    _need(isinstance(digits, int), "Function 'round' failed: digits must be a constant")
    return Value(F.bround(args[0].col, digits), args[0].dtype)


def _pow(args: list[Value]) -> Value:
    _need(len(args) == 2 and all(a.is_number for a in args), "Function 'pow' failed: needs two numbers")
    return _power(*args)


def _power(a: Value, b: Value) -> Value:
    out = F.pow(a.col, b.col)
    if a.is_int and b.is_int:
        whole = out.try_cast("bigint")
        large = out.isNotNull() & whole.isNull()
        return Value(whole, LONG, [(b.col < 0, "negative power of an integer"), (large, TOO_LARGE)])
    return Value(out, DOUBLE)


def _divmod(args: list[Value]) -> Value:
    _need(len(args) == 2 and all(a.is_number for a in args), "Function 'divmod' failed: needs two numbers")
    q, r = _floor_div(*args), _modulo(*args)
    joined = F.concat(F.lit("("), text_of(q), F.lit(", "), text_of(r), F.lit(")"))
    return Value(joined, STRING, q.checks)


def _bool(args: list[Value]) -> Value:
    _need(len(args) == 1, "Function 'bool' failed: needs one argument")
    return Value(_truth(args[0]), BOOL)


def _list_fn(name: str, build, keep_type: bool):
    def run(args: list[Value]) -> Value:
        _need(len(args) == 1 and args[0].is_list, f"Function '{name}' failed: needs a list")
        return Value(build(args[0].col), args[0].dtype if keep_type else args[0].dtype.elementType)

    return run


FUNCTIONS = {
    "abs": _abs,
    "bool": _bool,
    "capitalize": _string_fn("capitalize", lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))),
    "divmod": _divmod,
    "float": _float,
    "int": _int,
    "len": _len,
    "lower": _string_fn("lower", F.lower),
    "max": _extreme("max", F.greatest, F.array_max),
    "min": _extreme("min", F.least, F.array_min),
    "pow": _pow,
    "replace": _replace,
    "reversed": _list_fn("reversed", F.reverse, True),
    "round": _round,
    "sorted": _list_fn("sorted", F.array_sort, True),
    "str": lambda args: Value(text_of(args[0]) if args else F.lit(""), STRING),
    "strip": _string_fn("strip", lambda c: F.trim(c)),
    "sum": _list_fn("sum", lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b), False),
    "title": _string_fn("title", F.initcap),
    "upper": _string_fn("upper", F.upper),
}


def call(name: str, args: list[Value]) -> Value:
    if name not in FUNCTIONS:
        raise TemplateError(f"Function '{name}' is not allowed. Use one of: {', '.join(sorted(FUNCTIONS))}")
    out = FUNCTIONS[name](args)
    return Value(out.col, out.dtype, [c for a in args for c in a.checks] + out.checks)


# --- expressions --------------------------------------------------------------------------------


def _floor_div(a: Value, b: Value) -> Value:
    out = F.floor(F.try_divide(a.col, b.col))
    checks = [(b.col == 0, "division by zero")]
    return Value(out.cast("long"), LONG, checks) if a.is_int and b.is_int else Value(out.cast("double"), DOUBLE, checks)


def _modulo(a: Value, b: Value) -> Value:
    # The remainder takes the sign of the divisor.
    rest = a.col - b.col * F.floor(F.try_divide(a.col, b.col))
    checks = [(b.col == 0, "division by zero")]
    return Value(rest.cast("long"), LONG, checks) if a.is_int and b.is_int else Value(rest.cast("double"), DOUBLE, checks)


def _arithmetic(op: ast.operator, a: Value, b: Value) -> Value:
    if isinstance(op, ast.Add) and a.is_text and b.is_text:
        return Value(F.concat(a.col, b.col), STRING)
    _need(a.is_number and b.is_number, f"unsupported operands for {type(op).__name__}")
    kind = LONG if a.is_int and b.is_int else DOUBLE
    left, right = a.col.cast(kind), b.col.cast(kind)
    simple = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}
    for node, build in simple.items():
        if isinstance(op, node):
            out = build(left, right)
            large = left.isNotNull() & right.isNotNull() & out.isNull()
            return Value(out, kind, [(large, TOO_LARGE)] if kind == LONG else [])
    if isinstance(op, ast.Div):
        return Value(F.try_divide(a.col.cast("double"), b.col.cast("double")), DOUBLE, [(b.col == 0, "division by zero")])
    if isinstance(op, ast.FloorDiv):
        return _floor_div(a, b)
    if isinstance(op, ast.Mod):
        return _modulo(a, b)
    if isinstance(op, ast.Pow):
        return _power(a, b)
    raise TemplateError(f"operator {type(op).__name__} is not allowed")


COMPARISONS = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


def _either(cond: Column, a: Value, b: Value) -> Value:
    if a.dtype == b.dtype:
        return Value(F.when(cond, a.col).otherwise(b.col), a.dtype)
    if a.is_int and b.is_int:
        return Value(F.when(cond, a.col.cast("long")).otherwise(b.col.cast("long")), LONG)
    return Value(F.when(cond, text_of(a)).otherwise(text_of(b)), STRING)


def _literal(value) -> Value:
    kinds = {bool: BOOL, int: LONG, float: DOUBLE, str: STRING}
    if type(value) not in kinds:
        raise TemplateError(f"constant {value!r} is not allowed")
    out = Value(F.lit(value).cast(kinds[type(value)]), kinds[type(value)])
    out.constant = value
    return out


def variable(name: str, scope: dict[str, Value]) -> Value:
    """A variable, or a field of a struct variable written with dots."""
    base, *rest = name.split(".")
    if base not in scope:
        raise TemplateError(f"Variable '{base}' not found. Available variables: {', '.join(sorted(scope))}")
    found = scope[base]
    for part in rest:
        known = isinstance(found.dtype, T.StructType) and part in found.dtype.names
        _need(known, f"'{part}' is not a field of '{name}'")
        found = Value(found.col.getField(part), found.dtype[part].dataType, found.checks)
    return found


def expression(text: str, scope: dict[str, Value]) -> Value:
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError) as e:
        raise TemplateError(f"Failed to evaluate expression '{text}': {e}") from e
    return _walk(tree.body, scope)


def _walk(node: ast.expr, scope: dict[str, Value]) -> Value:
    if isinstance(node, ast.Constant):
        return _literal(node.value)
    if isinstance(node, (ast.Name, ast.Attribute)):
        return variable(ast.unparse(node), scope)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        return call(node.func.id, [_walk(a, scope) for a in node.args])
    parts: list[Value]
    if isinstance(node, ast.BinOp):
        parts = [_walk(node.left, scope), _walk(node.right, scope)]
        out = _arithmetic(node.op, *parts)
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        parts = [_walk(node.operand, scope)]
        _need(parts[0].is_number, "unary minus needs a number")
        out = Value(-parts[0].col, parts[0].dtype)
        if hasattr(parts[0], "constant"):
            out.constant = -parts[0].constant
            return out
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        parts = [_walk(node.operand, scope)]
        out = Value(~_truth(parts[0]), BOOL)
    elif isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARISONS:
        parts = [_walk(node.left, scope), _walk(node.comparators[0], scope)]
        same = parts[0].is_number == parts[1].is_number
        _need(same, "comparison of a number with text")
        out = Value(COMPARISONS[type(node.ops[0])](parts[0].col, parts[1].col), BOOL)
    elif isinstance(node, ast.BoolOp):
        parts = [_walk(v, scope) for v in node.values]
        out = parts[0]
        for nxt in parts[1:]:
            out = _either(_truth(out), nxt, out) if isinstance(node.op, ast.And) else _either(_truth(out), out, nxt)
    elif isinstance(node, ast.IfExp):
        cond, yes, no = (_walk(n, scope) for n in (node.test, node.body, node.orelse))
        out, holds = _either(_truth(cond), yes, no), _truth(cond)
        # Only the branch taken can fail.
        checks = cond.checks + [(holds & c, m) for c, m in yes.checks] + [(~holds & c, m) for c, m in no.checks]
        return Value(out.col, out.dtype, checks)
    else:
        raise TemplateError(f"{type(node).__name__} is not allowed in expressions")
    return Value(out.col, out.dtype, [c for p in parts for c in p.checks] + out.checks)


def _argument(text: str, scope: dict[str, Value]) -> Value:
    """Argument of a call outside brackets: ``<var>``, quoted text, number, variable name or bare word."""
    if text.startswith("<") and text.endswith(">"):
        return variable(text[1:-1].strip(), scope)
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return _literal(text[1:-1])
    if re.fullmatch(r"[+-]?\d+", text):
        return _literal(int(text))
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)", text):
        return _literal(float(text))
    return scope[text] if text in scope else _literal(text)


# --- whole templates ----------------------------------------------------------------------------


def compile_template(template: str, scope: dict[str, Value]) -> tuple[Column, Column]:
    """Text and per-row error of a template; raises :class:`TemplateError` when it can never work."""
    parts: list[Column] = []
    checks: list[tuple[Column, str]] = []
    at = 0
    for m in TOKEN.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m["count"]:
            parts.append(F.lit(f"%0{len(m['count'])}d"))
            continue
        if m["fn"]:
            args = [_argument(a.strip(), scope) for a in m["args"].split(",") if a.strip()]
            value = call(m["fn"], args)
        else:
            name = m["expr"].strip()
            value = scope[name] if name in scope else expression(name, scope)
        checks += value.checks
        parts.append(text_of(value))
    if at < len(template):
        parts.append(F.lit(template[at:]))
    error = F.coalesce(*[F.when(c, F.lit(m)) for c, m in checks]) if checks else F.lit(None).cast("string")
    return (F.concat(*parts) if parts else F.lit("")), error


def scope_of(df: DataFrame, variables: dict[str, Column], optional: set[str] = frozenset()) -> dict[str, Value]:
    """Variables with their types. A null in an ``optional`` variable is an error of that row."""
    types = df.select(*[c.alias(n) for n, c in variables.items()]).schema
    return {
        n: Value(c, types[n].dataType, [(c.isNull(), f"Variable '{n}' not found")] if n in optional else [])
        for n, c in variables.items()
    }


def render(df: DataFrame, template: str, variables: dict[str, Column], optional: set[str] = frozenset()) -> DataFrame:
    """Add ``rendered`` and ``template_error``; exactly one of them is null in each row."""
    text, error = compile_template(template, scope_of(df, variables, optional))
    return df.withColumn("template_error", error).withColumn(
        "rendered", F.when(F.col("template_error").isNull(), text)
    )


def used_variables(template: Column) -> Column:
    """Variables a template column mentions: names inside ``<...>`` that are not functions or words of
    the expression language; a dotted name counts as its first part."""
    inside = F.regexp_extract_all(template, F.lit("<([^>]+)>"), F.lit(1))
    bare = F.transform(inside, lambda e: F.regexp_replace(F.regexp_replace(e, "'[^']*'|\"[^\"]*\"", ""), r"\.\s*[A-Za-z_]\w*", ""))
    names = F.flatten(F.transform(bare, lambda e: F.regexp_extract_all(e, F.lit(r"(\b[A-Za-z_]\w*)"), F.lit(1))))
    reserved = F.array(*[F.lit(w) for w in (*sorted(FUNCTIONS), *KEYWORDS)])
    return F.array_except(F.array_distinct(names), reserved)


def missing_variables(template: Column, context: Column) -> Column:
    """Names a template needs and a context map lacks."""
    return F.array_except(used_variables(template), F.map_keys(context))
