"""A small arithmetic language compiled to columns.

Numbers, names, ``+ - * / %``, parentheses and a fixed set of functions; all
operators are left-associative. ``%`` works on unsigned 64-bit integers: both
sides are truncated. Names are replaced by columns, so Catalyst folds constants
and prunes what is not used.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|([A-Za-z_]\w*)|([-+*/%(),]))")
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2}


def _n_ary(fn):
    return lambda *a: fn(*a) if len(a) > 1 else a[0]


#: Functions by name: (number of arguments, builder).
FUNCTIONS = {"sqrt": (1, F.sqrt), "pow": (2, F.pow), "abs": (1, F.abs), "exp": (1, F.exp), "log": (1, F.log)}
FUNCTIONS |= {f"{name}{k if k > 2 else ''}": (k, _n_ary(fn)) for name, fn in (("max", F.greatest), ("min", F.least)) for k in range(2, 6)}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:].strip()[:10]!r} in {text!r}")
        out.append(next((kind, m[i]) for i, kind in ((1, "number"), (2, "name"), (3, "sign")) if m[i] is not None))
        at = m.end()
    if not out:
        raise ValueError("empty expression")
    return out


def compile_expression(text: str, names: Mapping[str, Column] | None = None) -> Column:
    """Column of ``text``; ``names`` maps names to columns (default: the column of that name)."""
    items, at = tokens(text), 0

    def peek() -> str | None:
        return items[at][1] if at < len(items) and items[at][0] == "sign" else None

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(items) or want and items[at] != ("sign", want):
            raise ValueError(f"expected {want or 'a value'} in {text!r}")
        at += 1
        return items[at - 1]

    def value() -> Column:
        kind, word = take()
        if kind == "number":
            return F.lit(float(word))
        if kind == "name" and peek() == "(":
            if word not in FUNCTIONS:
                raise ValueError(f"unknown function {word!r}")
            take("(")
            args = [level(1)]
            while peek() == ",":
                take(",")
                args.append(level(1))
            take(")")
            if len(args) != FUNCTIONS[word][0]:
                raise ValueError(f"{word} takes {FUNCTIONS[word][0]} arguments")
            return FUNCTIONS[word][1](*args)
        if kind == "name":
            if names is not None and word not in names:
                raise ValueError(f"unknown name {word!r}")
            return (names[word] if names is not None else F.col(word)).cast("double")
        if word == "(":
            inner = level(1)
            take(")")
            return inner
        raise ValueError(f"unexpected {word!r} in {text!r}")

    def level(rank: int) -> Column:
        left = value() if rank > 2 else level(rank + 1)
        while (op := peek()) and _RANK.get(op) == rank:
            take(op)
            right = value() if rank + 1 > 2 else level(rank + 1)
            if op == "%":
                left = F.pmod(left.cast("long"), right.cast("long")).cast("double")
            else:
                left = {"+": left + right, "-": left - right, "*": left * right, "/": left / right}[op]
        return left

    out = level(1)
    if at != len(items):
        raise ValueError(f"unexpected {items[at][1]!r} in {text!r}")
    return out
