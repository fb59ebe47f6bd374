"""Where the registered queries and their SQL twins are kept."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}
HOME: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL when it has one."""
    from .tables import Tables

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf: fn(Tables(spark, sf))
        HOME[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def cte(name: str, body: str) -> None:
    CTES[name] = body


def oracle() -> dict[str, str]:
    return {name: compose(sql) for name, sql in ORACLE.items()}


def compose(body: str) -> str:
    """Put the common table expressions that a statement mentions in front of it."""
    needed: list[str] = []

    def visit(text: str, of: str = "") -> None:
        for name in CTES:
            if name != of and name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    lead = "WITH RECURSIVE " if "RECURSIVE_MARK" in body else "WITH "
    body = body.replace("/*RECURSIVE_MARK*/", "")
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if own:
        return lead + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + ",\n" + body[own.end():]
    return lead + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body
