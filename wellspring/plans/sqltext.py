"""SQL snippets for the DuckDB oracle twins of the registered queries.

DuckDB uses RE2: ``\\s`` is ASCII there and ``regexp_replace`` replaces the
first match unless given the ``'g'`` flag, so the Unicode whitespace class of
Java's ``(?U)\\s`` is spelled out.
"""

from __future__ import annotations

WS = r"[\t\n\x0b\f\r\x{85}\p{Z}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def is_blank(expr: str) -> str:
    return f"regexp_matches({expr}, '^{WS}*$')"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def sample_key(id_expr: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({id_expr} AS VARCHAR))"


def word_count(expr: str) -> str:
    return f"len(list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda x: x <> ''))"


def fmt_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def rnd(expr: str, n: int) -> str:
    """Round a double like Spark's ``round`` (decimal HALF_UP on the value's
    decimal form), not DuckDB's floating-point ``round``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,18)), {n}) AS DOUBLE)"
