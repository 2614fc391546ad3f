"""Filter and transform expressions in the data-frame style, translated to Spark SQL text; nothing is executed.

Filters: comparisons (chained too), and/or/not, & | ~, in / not in with lists, == True, `quoted names`, and the methods
isnull, notnull, isna, notna, str.contains, str.startswith, str.endswith, between, isin. Transforms add arithmetic, **,
log10 and other functions, astype, fillna, replace (of whole values), str.replace (of parts), str.lower and the like.
"""

from __future__ import annotations

import ast
import re

_TYPES = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "int64": "bigint", "float64": "double", "object": "string"}
_FUNCTIONS = {
    "abs": "abs", "sqrt": "sqrt", "exp": "exp", "log": "ln", "log10": "log10", "log2": "log2", "log1p": "log1p", "expm1": "expm1", "sin": "sin", "cos": "cos", "tan": "tan",
    "arcsin": "asin", "arccos": "acos", "arctan": "atan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "floor": "floor", "ceil": "ceil", "round": "round",
}
_COMPARE = {ast.Eq: "=", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Mod: "%"}


class ExpressionError(ValueError):
    """An expression that cannot be translated."""


def _text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return f"{value!r}D" if isinstance(value, float) else repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Translator(ast.NodeVisitor):
    def __init__(self, quoted: dict[str, str]) -> None:
        self.quoted = quoted

    def generic_visit(self, node: ast.AST) -> str:
        raise ExpressionError(f"cannot translate {type(node).__name__}")

    def visit_Expression(self, node: ast.Expression) -> str:
        return self.visit(node.body)

    def visit_Name(self, node: ast.Name) -> str:
        if node.id in ("True", "False", "None"):
            return _text({"True": True, "False": False, "None": None}[node.id])
        return "`" + self.quoted.get(node.id, node.id).replace("`", "``") + "`"

    def visit_Constant(self, node: ast.Constant) -> str:
        return _text(node.value)

    def visit_BoolOp(self, node: ast.BoolOp) -> str:
        return "(" + (" AND " if isinstance(node.op, ast.And) else " OR ").join(map(self.visit, node.values)) + ")"

    def visit_UnaryOp(self, node: ast.UnaryOp) -> str:
        inner = self.visit(node.operand)
        return f"(NOT {inner})" if isinstance(node.op, (ast.Not, ast.Invert)) else f"(-{inner})" if isinstance(node.op, ast.USub) else inner

    def visit_BinOp(self, node: ast.BinOp) -> str:
        left, right = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            return f"({left} {'AND' if isinstance(node.op, ast.BitAnd) else 'OR'} {right})"
        if isinstance(node.op, ast.Pow):
            return f"power({left}, {right})"
        if isinstance(node.op, ast.Div):
            return f"try_divide(CAST({left} AS DOUBLE), {right})"
        if isinstance(node.op, ast.FloorDiv):
            return f"floor(try_divide(CAST({left} AS DOUBLE), {right}))"
        if type(node.op) not in _BINARY:
            raise ExpressionError(f"cannot translate {type(node.op).__name__}")
        return f"({left} {_BINARY[type(node.op)]} {right})"

    def visit_Compare(self, node: ast.Compare) -> str:
        parts, left = [], node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                    raise ExpressionError("in needs a list")
                values = [self.visit(x) for x in right.elts]
                inside = f"coalesce({self.visit(left)} IN ({', '.join(values)}), false)" if values else "false"
                parts.append(inside if isinstance(op, ast.In) else f"(NOT {inside})")
            elif type(op) is ast.NotEq:  # missing values differ from everything
                parts.append(f"(NOT ({self.visit(left)} <=> {self.visit(right)}))")
            elif type(op) in _COMPARE:
                parts.append(f"coalesce({self.visit(left)} {_COMPARE[type(op)]} {self.visit(right)}, false)")
            else:
                raise ExpressionError(f"cannot translate {type(op).__name__}")
            left = right
        return parts[0] if len(parts) == 1 else "(" + " AND ".join(parts) + ")"

    def visit_Call(self, node: ast.Call) -> str:
        args = [self.visit(a) for a in node.args]
        if isinstance(node.func, ast.Name):
            if node.func.id not in _FUNCTIONS:
                raise ExpressionError(f"unknown function {node.func.id}")
            return f"{_FUNCTIONS[node.func.id]}({', '.join(args)})"
        if not isinstance(node.func, ast.Attribute):
            raise ExpressionError("cannot translate this call")
        name, base = node.func.attr, node.func.value
        if isinstance(base, ast.Name) and base.id in ("np", "numpy", "math"):
            if name not in _FUNCTIONS:
                raise ExpressionError(f"unknown function {name}")
            return f"{_FUNCTIONS[name]}({', '.join(args)})"
        if isinstance(base, ast.Attribute) and base.attr == "str":
            x = self.visit(base.value)
            simple = {"lower": "lower", "upper": "upper", "strip": "trim", "lstrip": "ltrim", "rstrip": "rtrim", "len": "length"}
            if name in simple and not args:
                return f"{simple[name]}({x})"
            if name == "replace" and len(args) == 2:
                return f"replace({x}, {args[0]}, {args[1]})"
            found = {"contains": "contains", "startswith": "startswith", "endswith": "endswith"}
            if name in found and len(args) == 1:
                return f"coalesce({found[name]}({x}, {args[0]}), false)"
            raise ExpressionError(f"unknown string method {name}")
        x = self.visit(base)
        if name in ("isnull", "isna"):
            return f"({x} IS NULL)"
        if name in ("notnull", "notna"):
            return f"({x} IS NOT NULL)"
        if name == "between" and len(args) == 2:
            return f"coalesce({x} BETWEEN {args[0]} AND {args[1]}, false)"
        if name == "isin" and len(node.args) == 1 and isinstance(node.args[0], (ast.List, ast.Tuple)):
            return f"coalesce({x} IN ({', '.join(self.visit(a) for a in node.args[0].elts) or 'NULL'}), false)"
        if name == "astype" and len(node.args) == 1:
            kind = node.args[0].id if isinstance(node.args[0], ast.Name) else node.args[0].value if isinstance(node.args[0], ast.Constant) else None
            if kind not in _TYPES:
                raise ExpressionError(f"unknown type {kind}")
            return f"CAST({x} AS {_TYPES[kind]})"
        if name == "fillna" and len(args) == 1:
            return f"coalesce({x}, {args[0]})"
        if name == "replace" and len(args) == 2:
            return f"CASE WHEN {x} = {args[0]} THEN {args[1]} ELSE {x} END"
        if name in _FUNCTIONS:
            return f"{_FUNCTIONS[name]}({', '.join([x, *args])})"
        raise ExpressionError(f"unknown method {name}")

    def visit_List(self, node: ast.List) -> str:
        return "array(" + ", ".join(map(self.visit, node.elts)) + ")"


def to_sql(expression: str) -> str:
    """Spark SQL for a filter or value expression. Comparisons with missing values are false, `!=` true."""
    quoted: dict[str, str] = {}

    def stand_in(m: re.Match) -> str:
        name = f"quoted_name_{len(quoted)}"
        quoted[name] = m[1]
        return name

    text = re.sub(r"`([^`]+)`", stand_in, expression.strip())
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"invalid expression {expression!r}") from e
    return _Translator(quoted).visit(tree)


def assignment(expression: str) -> tuple[str, str]:
    """(column, SQL) of `column = expression`."""
    m = re.match(r"\s*(?:`([^`]+)`|([A-Za-z_]\w*))\s*=(?!=)(.*)\Z", expression, re.S)
    if not m:
        raise ExpressionError(f"no assignment: {expression!r}")
    return m[1] or m[2], to_sql(m[3])
