"""Named queries over the provided tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrywell.plans.inputs import DERIVED, NEEDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}
# Intermediate results that several expectations share: name -> (views it reads, SQL).
SHARED: dict[str, tuple[list[str], str]] = {}


def query(name: str, sql: str | None = None, reads: list[str] = (), recursive: bool = False):
    """Register a query; ``reads`` names the derived views its SQL mentions."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            EXPECTED[name] = with_views(list(reads), sql, recursive)
        return run

    return register


def with_views(names: list[str], sql: str, recursive: bool = False) -> str:
    """Put the derived views before the statement as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in DERIVED:
            needed, text = NEEDS[name], DERIVED[name]
        elif name in SHARED:
            needed, text = SHARED[name]
        else:
            return
        for other in needed:
            add(other)
        part = f"{name} as ({text})"
        if part not in ordered:
            ordered.append(part)

    for name in names:
        add(name)
    if not ordered:
        return sql
    head = "with recursive " if recursive else "with "
    # a statement with expressions of its own continues the list
    own = sql.lstrip()
    if own.lower().startswith("with "):
        rest = own[5:].lstrip()
        rest = rest[10:] if rest.lower().startswith("recursive ") else rest
        return head + ",\n".join(ordered) + ",\n" + rest
    return head + ",\n".join(ordered) + "\n" + sql
