"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """Name a subquery that oracle statements may refer to."""
    CTES[name] = body.strip()


def with_ctes(select: str) -> str:
    """Prefix ``select`` with the subqueries it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bc_\w+", text)):
            if word in CTES and word not in ordered:
                visit(CTES[word])
                if word not in ordered:
                    ordered.append(word)

    visit(select)
    if not ordered:
        return select.strip()
    parts = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in ordered)
    body = select.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{body[15:]}"
    if body.startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    return {name: with_ctes(text) for name, text in ORACLES.items()}
