"""Identifiers: validation, quoting, case-insensitive resolution, qualified names, literals."""

from __future__ import annotations

import re
from collections.abc import Iterable

PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*\Z")
#: The only system at hand that folds unquoted names is listed; others keep them.
IDENTIFIER_CASE = {"snowflake": "upper"}


def check_identifier(name: str) -> str:
    if not isinstance(name, str) or not PLAIN.match(name):
        raise ValueError(f"Invalid identifier: {name!r}")
    return name


def quote_identifier(name: str, case: str = "preserve", mark: str = "`") -> str:
    """A validated name for SQL text, each part between marks."""
    check_identifier(name)
    folded = {"upper": str.upper, "lower": str.lower, "preserve": str}[case](name)
    return ".".join(f"{mark}{part}{mark}" for part in folded.split("."))


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def column(name: str):
    """A column by its exact name, whatever characters it has."""
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")


def resolve(name: str, columns: Iterable[str]) -> str:
    """The column that name means: exact first, else the only one equal but for case."""
    columns = list(columns)
    if name in columns:
        return name
    found = [c for c in columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"Column {name!r} is {'ambiguous' if found else 'not'} among {columns}")
    return found[0]


def common_columns(a: Iterable[str], b: Iterable[str]) -> list[tuple[str, str]]:
    """(name in a, name in b) of the columns that both have, in a's order."""
    there = {c.lower(): c for c in b}
    return [(c, there[c.lower()]) for c in a if c.lower() in there]


def non_keys(columns: Iterable[str], keys: Iterable[str]) -> list[str]:
    taken = {k.lower() for k in keys}
    return [c for c in columns if c.lower() not in taken]


def split_name(name: str) -> tuple[str | None, str]:
    """Schema and table of a one-, two- or three-part name; quotes are dropped, the last two parts count."""
    parts = [p.strip().strip("\"`'[]") for p in name.split(".")]
    if not all(parts) or len(parts) > 3:
        raise ValueError(f"Invalid table name: {name!r}")
    return (parts[-2] if len(parts) > 1 else None), parts[-1]
