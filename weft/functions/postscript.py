"""Calculator programs compiled to Column expressions.

The operand stack lives on the driver and holds Columns; stack operators move
them, arithmetic builds larger expressions, and ``if`` / ``ifelse`` run both
branches and join the stacks with ``when``.  Truth is a number that is not 0.
Errors of a row (division by zero, logarithm or root out of domain) give null.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\{|\}|[^\s{}]+")


class ProgramError(ValueError):
    """The program cannot run on any input."""


def parse(source: str) -> list:
    """Nested lists of tokens; procedures are lists."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(source):
        if token == "{":
            stack.append([])
        elif token == "}":
            if len(stack) == 1:
                raise ProgramError("unbalanced procedure")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token)
    if len(stack) != 1:
        raise ProgramError("unbalanced procedure")
    body = stack[0]
    return body[0] if len(body) == 1 and isinstance(body[0], list) else body


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


_BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "idiv": lambda a, b: _trunc(F.try_divide(a, b)),
    "mod": lambda a, b: F.when(b != 0, a % F.nullif(b, F.lit(0.0))),
    "exp": lambda a, b: F.pow(a, b),
    "atan": lambda a, b: F.degrees(F.atan2(a, b)),
    "eq": lambda a, b: _flag(a == b),
    "ne": lambda a, b: _flag(a != b),
    "gt": lambda a, b: _flag(a > b),
    "ge": lambda a, b: _flag(a >= b),
    "lt": lambda a, b: _flag(a < b),
    "le": lambda a, b: _flag(a <= b),
    "and": lambda a, b: _flag((a != 0) & (b != 0)),
    "or": lambda a, b: _flag((a != 0) | (b != 0)),
    "xor": lambda a, b: _flag((a != 0) != (b != 0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}
_UNARY = {
    "abs": F.abs,
    "neg": lambda v: -v,
    "ceiling": lambda v: F.ceil(v).cast("double"),
    "floor": lambda v: F.floor(v).cast("double"),
    "round": lambda v: F.round(v),
    "truncate": _trunc,
    "cvi": _trunc,
    "cvr": lambda v: v,
    "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)),
    "sin": lambda v: F.sin(F.radians(v)),
    "cos": lambda v: F.cos(F.radians(v)),
    "ln": lambda v: F.when(v > 0, F.ln(v)),
    "log": lambda v: F.when(v > 0, F.log10(v)),
    "not": lambda v: _flag(v == 0),
}


def _whole(x: Column) -> Column:
    return _trunc(x).cast("bigint")


def _shifted(a: Column, b: Column) -> Column:
    """Left for positive counts, right, with the sign, for others; 64 places and more leave nothing but the sign."""
    v, n = _whole(a), _whole(b)
    left = F.when(n > 63, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", v, F.least(n, F.lit(63)).cast("int")))
    right = F.call_function("shiftright", v, F.least(-n, F.lit(63)).cast("int"))
    return F.when(n > 0, left).otherwise(right).cast("double")


#: Where the second evaluator differs: whole numbers for logic, angles from 0 to 360, floors for whole numbers, NaN for roots.
_BITWISE = {
    "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
    "and": lambda a, b: _whole(a).bitwiseAND(_whole(b)).cast("double"),
    "or": lambda a, b: _whole(a).bitwiseOR(_whole(b)).cast("double"),
    "xor": lambda a, b: _whole(a).bitwiseXOR(_whole(b)).cast("double"),
    "bitshift": _shifted,
}
_BITWISE_UNARY = {
    "not": lambda v: F.bitwise_not(_whole(v)).cast("double"),
    "cvi": lambda v: F.floor(v).cast("double"),
    "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)).otherwise(F.when(v.isNotNull(), F.lit(float("nan")))),
    "sin": lambda v: F.sin(F.radians(v % 360)),
    "cos": lambda v: F.cos(F.radians(v % 360)),
}
_ONLY_LOGICAL = {"max", "min"}


def _operators(bitwise: bool) -> tuple[dict, dict]:
    if not bitwise:
        return _BINARY, _UNARY
    return {k: v for k, v in (_BINARY | _BITWISE).items() if k not in _ONLY_LOGICAL}, _UNARY | _BITWISE_UNARY


def _constant(item) -> int:
    if not isinstance(item, float):
        raise ProgramError("a stack operator needs a literal count")
    return math.floor(abs(item) + 0.5) * (1 if item >= 0 else -1)


def _column(item) -> Column:
    if isinstance(item, list):
        raise ProgramError("a number is expected where a procedure stands")
    return F.lit(item) if isinstance(item, float) else item


def _run(tokens: list, stack: list, bitwise: bool = False) -> list:
    binary, unary = _operators(bitwise)

    def pop():
        if not stack:
            raise ProgramError("stack underflow")
        return stack.pop()

    for token in tokens:
        if isinstance(token, list):
            stack.append(token)
        elif token in ("true", "false"):
            stack.append(1.0 if token == "true" else 0.0)
        elif token in binary:
            b, a = _column(pop()), _column(pop())
            stack.append(binary[token](a, b))
        elif token in unary:
            stack.append(unary[token](_column(pop())))
        elif token == "pop":
            pop()
        elif token == "dup":
            stack.append(pop())
            stack.append(stack[-1])
        elif token == "exch":
            b, a = pop(), pop()
            stack += [b, a]
        elif token == "copy":
            n = _constant(pop())
            if not 0 <= n <= len(stack):
                raise ProgramError("copy count out of range")
            stack += stack[len(stack) - n :]
        elif token == "index":
            n = _constant(pop())
            if not 0 <= n < len(stack):
                raise ProgramError("index out of range")
            stack.append(stack[-1 - n])
        elif token == "roll":
            j, n = _constant(pop()), _constant(pop())
            if not 0 <= n <= len(stack):
                raise ProgramError("roll count out of range")
            if n:
                top = stack[len(stack) - n :]
                j %= n
                stack[len(stack) - n :] = top[n - j :] + top[: n - j]
        elif token in ("if", "ifelse"):
            no = pop() if token == "ifelse" else []
            yes, condition = pop(), _column(pop())
            if not isinstance(yes, list) or not isinstance(no, list):
                raise ProgramError("a procedure is expected")
            one, two = _run(yes, list(stack), bitwise), _run(no, list(stack), bitwise)
            if len(one) != len(two):
                raise ProgramError("branches leave stacks of different depth")
            stack = [a if a is b else F.when(condition != 0, _column(a)).otherwise(_column(b)) for a, b in zip(one, two)]
        else:
            try:
                stack.append(float(token))
            except ValueError:
                raise ProgramError(f"unknown operator {token}") from None
    return stack


def compile_program(source: str, *inputs: Column, bitwise: bool = False) -> list[Column]:
    """The stack that the program leaves, bottom first; ``bitwise`` picks the evaluator of standalone functions."""
    return [_column(x) for x in _run(parse(source), [i.cast("double") for i in inputs], bitwise)]
