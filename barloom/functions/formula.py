"""A small language of formulas over features: parsed once, then compiled to Spark columns, to SQL or to numpy.

A program is a prefix list of nodes: operator names, feature names and numbers. Its text is ``fn(arg, ...)``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Node = str | float
Program = tuple[Node, ...]

#: Operators and their numbers of arguments (fixed values).
ARITY = {"add": 2, "sub": 2, "mul": 2, "div": 2, "max": 2, "min": 2, "abs": 1, "neg": 1, "gt": 2, "lt": 2, "and": 2, "or": 2, "if_then": 3}
LOGIC = ("lt", "gt", "and", "or")
SOFT, FLOOR = 3.0, 0.001

COLUMN = {
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y,
    "div": lambda x, y: F.when(F.abs(y) > FLOOR, F.try_divide(x, y)).otherwise(1.0),
    "max": lambda x, y: F.greatest(x, y),
    "min": lambda x, y: F.least(x, y),
    "abs": lambda x: F.abs(x),
    "neg": lambda x: -x,
    "gt": lambda x, y: F.tanh((x - y) * SOFT),
    "lt": lambda x, y: F.tanh((y - x) * SOFT),
    "and": lambda x, y: F.least(x, y),
    "or": lambda x, y: F.greatest(x, y),
    "if_then": lambda c, x, y: F.when(c > 0, x).otherwise(y),
}
SQL = {
    "add": "({0} + {1})",
    "sub": "({0} - {1})",
    "mul": "({0} * {1})",
    "div": "(CASE WHEN abs({1}) > 0.001 THEN {0} / {1} ELSE 1.0 END)",
    "max": "greatest({0}, {1})",
    "min": "least({0}, {1})",
    "abs": "abs({0})",
    "neg": "(-{0})",
    "gt": "tanh(({0} - {1}) * 3.0)",
    "lt": "tanh(({1} - {0}) * 3.0)",
    "and": "least({0}, {1})",
    "or": "greatest({0}, {1})",
    "if_then": "(CASE WHEN {0} > 0 THEN {1} ELSE {2} END)",
}
NUMPY = {
    "add": np.add,
    "sub": np.subtract,
    "mul": np.multiply,
    "div": lambda x, y: np.where(np.abs(y) > FLOOR, np.divide(x, np.where(np.abs(y) > FLOOR, y, 1.0)), 1.0),
    "max": np.maximum,
    "min": np.minimum,
    "abs": np.abs,
    "neg": np.negative,
    "gt": lambda x, y: np.tanh((x - y) * SOFT),
    "lt": lambda x, y: np.tanh((y - x) * SOFT),
    "and": np.minimum,
    "or": np.maximum,
    "if_then": lambda c, x, y: np.where(c > 0, x, y),
}
TOKEN = re.compile(r"\s*([A-Za-z_]\w*|-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|[(),])")


def parse(text: str) -> Program:
    """The program of a formula's text; an operator with another number of arguments than its own is an error."""
    tokens = TOKEN.findall(text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"not a formula: {text}")
    out: list[Node] = []
    at = 0

    def term() -> None:
        nonlocal at
        if at >= len(tokens) or tokens[at] in "(),":
            raise ValueError(f"a term is missing in {text}")
        name = tokens[at]
        at += 1
        if at < len(tokens) and tokens[at] == "(":
            if name not in ARITY:
                raise ValueError(f"no operator {name}")
            out.append(name)
            for i in range(ARITY[name]):
                if at >= len(tokens) or tokens[at] != ("," if i else "("):
                    raise ValueError(f"{name} takes {ARITY[name]} arguments: {text}")
                at += 1
                term()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"{name} takes {ARITY[name]} arguments: {text}")
            at += 1
        else:
            out.append(name if re.match(r"[A-Za-z_]", name) else float(name))

    term()
    if at != len(tokens):
        raise ValueError(f"text after the formula: {text}")
    return tuple(out)


def is_operator(program: Sequence[Node], i: int) -> bool:
    """Features may bear an operator's name only as terminals of parsed text; in programs the name is the operator."""
    return isinstance(program[i], str) and program[i] in ARITY


def fold(program: Program, leaf, apply):
    """The value of a program: ``leaf(node)`` at terminals, ``apply(name, *args)`` at operators, from right to left."""
    stack = []
    for node in reversed(program):
        if isinstance(node, str) and node in ARITY:
            args = [stack.pop() for _ in range(ARITY[node])]
            stack.append(apply(node, *args))
        else:
            stack.append(leaf(node))
    return stack.pop()


def show(program: Program) -> str:
    return fold(program, str, lambda f, *a: f"{f}({', '.join(a)})")


def to_column(program: Program | str) -> Column:
    p = parse(program) if isinstance(program, str) else program
    return fold(p, lambda x: F.col(x) if isinstance(x, str) else F.lit(float(x)), lambda f, *a: COLUMN[f](*a))


def to_sql(program: Program | str) -> str:
    p = parse(program) if isinstance(program, str) else program
    return fold(p, lambda x: x if isinstance(x, str) else f"({x!r}::DOUBLE)", lambda f, *a: SQL[f].format(*a))


def evaluate(program: Program, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Over whole numpy columns; a constant fills all rows."""
    with np.errstate(all="ignore"):
        out = fold(program, lambda x: columns[x] if isinstance(x, str) else np.float64(x), lambda f, *a: NUMPY[f](*a))
    return np.broadcast_to(np.asarray(out, np.float64), (n,))


def features_used(program: Program | str) -> set[str]:
    p = parse(program) if isinstance(program, str) else program
    return {x for x in p if isinstance(x, str) and x not in ARITY}


def cancels(program: Program | str) -> bool:
    """Whether sub(X, X) or add(X, neg(X)) stands anywhere in the program, by the arguments' own programs."""
    p = parse(program) if isinstance(program, str) else program
    found = False

    def apply(f: str, *args: Program) -> Program:
        nonlocal found
        if f == "sub" and args[0] == args[1] or f == "add" and args[1] == ("neg", *args[0]):
            found = True
        return (f, *[x for a in args for x in a])

    fold(p, lambda x: (x,), apply)
    return found


def guard(program: Program | str, least_features: int = 3, most_nodes: int = 40, most_logic: float = 0.60) -> str | None:
    """Why a formula is refused, or None."""
    p = parse(program) if isinstance(program, str) else program
    if len(features_used(p)) < least_features:
        return "too few features"
    if len(p) > most_nodes:
        return "too long"
    if cancels(p):
        return "cancels"
    ops = [x for x in p if isinstance(x, str) and x in ARITY]
    if len(ops) > 4 and sum(x in LOGIC for x in ops) > most_logic * len(ops):
        return "mostly logic"
    return None


def identifiers(text: str | Column) -> Column:
    """Distinct names in a formula column's text that are no operators."""
    c = F.col(text) if isinstance(text, str) else text
    names = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)))
    return F.array_except(names, F.array(*[F.lit(x) for x in ARITY]))


def used_of(text: str | Column, known: list[str]) -> Column:
    return F.array_sort(F.array_intersect(identifiers(text), F.array(*[F.lit(x) for x in known])))


def formula_hash(text: str) -> Column:
    return F.sha2(F.col(text), 256)
