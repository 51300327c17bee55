"""Filter and projection language over ordered rows: text -> typed tree -> Spark columns.

X[k][c] is the cell of column c (name or number) k rows away; X[k] and X[k][*] are all cells of that row.
Operators have C's precedence. Integers are 64-bit, floats double; && and || stop early.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import TAG, UNSIGNED

BOOL, INT, UINT, FLOAT, STRING = "bool", "int", "uint", "float", "string"
LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]
_BINDS = {op: k for k, ops in enumerate(LEVELS) for op in ops}
_TOKEN = re.compile(r'\s*(?:(0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|("(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^~!<>()\[\],]))')
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t"}
I64_MAX, I64_MIN, U64 = 2**63 - 1, -(2**63), 2**64


class ExprError(ValueError):
    def __init__(self, message: str, position: int | None = None):
        super().__init__(message if position is None else f"{message} (at {position})")
        self.position = position


@dataclass
class Node:
    op: str
    args: list = field(default_factory=list)
    position: int = 0


def tokens(text: str) -> list[tuple[str, object, int]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            at += len(text[at:]) - len(text[at:].lstrip())
            raise ExprError(f"unexpected character {text[at]!r}", at)
        start = m.start(m.lastindex)
        number, string, word, sign = m.groups()
        if number:
            value = int(number, 16) if number[:2].lower() == "0x" else float(number) if re.search(r"[.eE]", number) else int(number)
            if isinstance(value, int) and value >= U64:
                raise ExprError("integer is too large", start)
            if m.end() < len(text) and text[m.end()] == ".":
                raise ExprError("a number needs digits after its point", m.end())
            out.append(("num", value, start))
        elif string:
            bad = re.search(r"\\([^\"\\nt])", re.sub(r"\\\\", "", string[1:-1]))
            if bad:
                raise ExprError(f"unknown escape \\{bad[1]}", start)
            out.append(("str", re.sub(r"\\(.)", lambda e: _ESCAPES[e[1]], string[1:-1]), start))
        elif word:
            if word not in ("true", "false", "X"):
                raise ExprError(f"unknown identifier: {word}", start)
            out.append(("X", None, start) if word == "X" else ("bool", word == "true", start))
        else:
            out.append((sign, None, start))
        at = m.end()
    return [*out, ("end", None, len(text))]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][0]

    def take(self, kind: str | None = None):
        token = self.tokens[self.at]
        if kind and token[0] != kind:
            raise ExprError(f"expected {kind}, found {token[0]}", token[2])
        self.at += 1
        return token

    def binary(self, level: int = 0) -> Node:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in LEVELS[level]:
            op, _, position = self.take()
            left = Node(op, [left, self.binary(level + 1)], position)
        return left

    def unary(self) -> Node:
        if self.peek() in "-!~":
            op, _, position = self.take()
            return Node("u" + op, [self.unary()], position)
        kind, value, position = self.take()
        if kind == "(":
            inner = self.binary()
            self.take(")")
            return inner
        if kind in ("num", "str", "bool"):
            return Node("lit", [value], position)
        if kind != "X":
            raise ExprError(f"unexpected {kind}", position)
        self.take("[")
        sign = self.take()[0] if self.peek() in ("+", "-") else "+"
        row = self.take("num")
        if not isinstance(row[1], int):
            raise ExprError("a row offset is an integer", row[2])
        offset = -row[1] if sign == "-" else row[1]
        if not -(2**15) <= offset < 2**15:
            raise ExprError("row offset out of range", row[2])
        self.take("]")
        if self.peek() != "[":
            return Node("row", [offset], position)
        self.take("[")
        kind, value, at = self.take()
        if kind not in ("num", "str", "*") or isinstance(value, float):
            raise ExprError("a column is a number, a name or *", at)
        self.take("]")
        return Node("row", [offset], position) if kind == "*" else Node("cell", [offset, value], position)

    def done(self) -> None:
        if self.peek() != "end":
            raise ExprError(f"unexpected {self.peek()}", self.tokens[self.at][2])


def parse_condition(text: str) -> Node:
    p = Parser(text)
    out = p.binary()
    p.done()
    return out


def parse_selection(text: str) -> list[Node]:
    p = Parser(text)
    out = [p.binary()]
    while p.peek() == ",":
        p.take()
        out.append(p.binary())
    p.done()
    return out


def kind_of(field: T.StructField) -> str:
    """The language's type of a column: its logical type, if its metadata has one, or else its Spark type."""
    logical = (field.metadata or {}).get(TAG, "")
    if logical in UNSIGNED or isinstance(field.dataType, T.DecimalType) and not logical:
        return UINT
    if isinstance(field.dataType, T.BooleanType):
        return BOOL
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(field.dataType, T.StringType):
        return STRING
    if isinstance(field.dataType, T.IntegralType) or isinstance(field.dataType, T.DecimalType):
        return INT
    raise ExprError(f"column {field.name} has a type that expressions can't use: {field.dataType.simpleString()}")


class Compiler:
    """Trees -> columns over a schema. Cells are named by `cell(offset, column number)`, which the caller makes."""

    def __init__(self, schema: T.StructType, cell, on_error: str = "throw"):
        if on_error not in ("throw", "skip_row", "saturate"):
            raise ValueError("on_error is throw, skip_row or saturate")
        self.schema, self.cell, self.on_error = schema, cell, on_error
        self.may_skip = False
        self.offsets: set[int] = {0}

    def number(self, name, position: int) -> int:
        names = self.schema.names
        if isinstance(name, str):
            if name not in names:
                raise ExprError(f"unknown column: {name}", position)
            return names.index(name)
        if not 0 <= name < len(names):
            raise ExprError(f"column number out of range: {name}", position)
        return name

    def condition(self, node: Node) -> Column:
        return self.truth(*self.value(node), node)

    def truth(self, c: Column, kind: str, node: Node) -> Column:
        if kind == STRING:
            raise ExprError("a string is no condition", node.position)
        return c if kind == BOOL else c != 0

    def value(self, node: Node) -> tuple[Column, str]:
        op = node.op
        if op == "lit":
            v = node.args[0]
            if isinstance(v, bool):
                return F.lit(v), BOOL
            if isinstance(v, str):
                return F.lit(v), STRING
            if isinstance(v, float):
                return F.lit(v), FLOAT
            return (F.lit(v).cast("long"), INT) if v <= I64_MAX else (F.lit(str(v)).cast("decimal(20,0)"), UINT)
        if op == "row":
            raise ExprError("a whole row can't be part of an expression", node.position)
        if op == "cell":
            n = self.number(node.args[1], node.position)
            self.offsets.add(node.args[0])
            kind, c = kind_of(self.schema[n]), self.cell(node.args[0], n)
            return (c.cast({INT: "long", UINT: "decimal(20,0)", FLOAT: "double"}[kind]) if kind in (INT, UINT, FLOAT) else c), kind
        if op in ("&&", "||"):
            l, r = self.condition(node.args[0]), self.condition(node.args[1])  # noqa: E741
            head = F.when(l.isNull(), F.lit(None).cast("boolean"))
            return (head.when(l, r).otherwise(False) if op == "&&" else head.when(l, True).otherwise(r)), BOOL
        if op == "u!":
            return ~self.condition(node.args[0]), BOOL
        if op[0] == "u":
            return self.unary(op[1], *self.value(node.args[0]), node)
        return self.binary(op, self.value(node.args[0]), self.value(node.args[1]), node)

    def unary(self, op: str, c: Column, kind: str, node: Node) -> tuple[Column, str]:
        if kind == STRING or op == "-" and kind == BOOL or op == "~" and kind == FLOAT:
            raise ExprError(f"{op} doesn't take {kind}", node.position)
        if op == "-":
            return (-c, FLOAT) if kind == FLOAT else (word("-", F.lit(0).cast("long"), signed(c, kind)), INT)
        return F.bitwise_not(signed(c, kind)), INT

    def binary(self, op: str, left, right, node: Node) -> tuple[Column, str]:
        (a, ka), (b, kb) = left, right
        if STRING in (ka, kb):
            if ka == kb and op in ("==", "!="):
                return (a == b if op == "==" else a != b), BOOL
            raise ExprError(f"{op} doesn't take {ka} and {kb}", node.position)
        if op in ("|", "&", "^", "<<", ">>"):
            if FLOAT in (ka, kb):
                raise ExprError(f"{op} takes integers", node.position)
            a, b = signed(a, ka), signed(b, kb)
            if op in ("<<", ">>"):
                n = F.least(F.lit(63), F.greatest(F.lit(0), b)).cast("int")
                return F.call_function("shiftleft" if op == "<<" else "shiftright", a, n), INT
            return {"|": a.bitwiseOR, "&": a.bitwiseAND, "^": a.bitwiseXOR}[op](b), INT
        kind = FLOAT if FLOAT in (ka, kb) else INT if op not in ("==", "!=", "<", "<=", ">", ">=") and INT in (ka, kb) or UINT not in (ka, kb) else UINT
        if op in ("==", "!=", "<", "<=", ">", ">="):
            a, b = promoted(a, ka, kind), promoted(b, kb, kind)
            c = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            if kind != FLOAT:
                return c, BOOL
            odd = F.isnan(a) | F.isnan(b)
            return (odd | c if op == "!=" else ~odd & c), BOOL
        a, b = promoted(a, ka, kind), promoted(b, kb, kind)
        if op == "%" and kind == FLOAT:
            raise ExprError("% takes integers", node.position)
        if kind == FLOAT:
            return {"+": a + b, "-": a - b, "*": a * b}[op] if op != "/" else float_quotient(a, b), FLOAT
        if op in "+-*":
            if kind == UINT:
                return wrapped({"+": a + b, "-": a - b, "*": a.cast("decimal(38,0)") * b}[op]), UINT
            return word(op, a, b), INT
        return self.integer_quotient(op, a, b, kind), kind

    def integer_quotient(self, op: str, a: Column, b: Column, kind: str) -> Column:
        to = "long" if kind == INT else "decimal(20,0)"
        safe = F.nullif(b, F.lit(0).cast(to))
        good = (F.call_function("div", a, safe) if op == "/" else a % safe).cast(to)
        if self.on_error == "throw":
            zero = F.raise_error(F.lit("division by zero" if op == "/" else "modulo by zero")).cast(to)
        elif self.on_error == "skip_row":
            self.may_skip, zero = True, F.lit(None).cast(to)
        elif op == "%":
            zero = F.lit(0).cast(to)
        else:
            zero = F.when(a >= 0, F.lit(I64_MAX)).otherwise(F.lit(I64_MIN)).cast(to) if kind == INT else F.lit(str(U64 - 1)).cast(to)
        return F.when(b == 0, zero).otherwise(good)


def signed(c: Column, kind: str) -> Column:
    """As a 64-bit integer; unsigned values of 2^63 and more become negative, with the same bits."""
    if kind == UINT:
        return F.when(c > I64_MAX, c - F.lit(str(U64)).cast("decimal(21,0)")).otherwise(c).cast("long")
    return c.cast("long")


def word(op: str, a: Column, b: Column) -> Column:
    """Signed 64-bit arithmetic that wraps around, whatever the session's ANSI setting."""
    x, y = (c.cast("decimal(19,0)") for c in (a, b))
    exact = {"+": x + y, "-": x - y, "*": x * y}[op]
    return F.coalesce({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b), signed(wrapped(exact), UINT))


def wrapped(c: Column) -> Column:
    return F.pmod(c, F.lit(str(U64)).cast("decimal(21,0)")).cast("decimal(20,0)")


def promoted(c: Column, kind: str, to: str) -> Column:
    if kind == to:
        return c
    if to == FLOAT:
        return c.cast("int").cast("double") if kind == BOOL else c.cast("double")
    return (signed(c, kind) if to == INT else c.cast("long").cast("decimal(20,0)")) if kind != BOOL else c.cast("int").cast("long" if to == INT else "decimal(20,0)")


def float_quotient(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity, or NaN for 0/0."""
    side = F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    zero = F.when(F.isnan(a) | (a == 0), float("nan")).otherwise(F.signum(a) * side * float("inf"))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))
