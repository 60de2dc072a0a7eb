"""Pieces of SQL text.

Reports compute the same few expressions for every column of a table. Writing them as
SQL text hands each one to Spark in a single call.
"""

from __future__ import annotations


def name(column: str) -> str:
    """A quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double(value: float | None) -> str:
    """A double literal with all its digits."""
    return "cast(null as double)" if value is None else f"double('{float(value)!r}')"
