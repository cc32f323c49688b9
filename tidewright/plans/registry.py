"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans.derived import DERIVED_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Inventory rows that each query covers.
COVERS: dict[str, tuple[str, ...]] = {}


def query(covers: str, sql: str = "", uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame under its name. *uses*: derived tables that *sql* reads."""

    def register(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        COVERS[name] = tuple(covers.split())
        if sql:
            ctes = ",\n".join(f"{t} AS ({DERIVED_SQL[t]})" for t in _closure(uses))
            body = sql.strip()
            if ctes:
                head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.startswith(h)), "")
                body = f"{head}{ctes},\n{body[len(head):]}" if head else f"WITH {ctes}\n{body}"
            SQL[name] = body
        return function

    return register


def _closure(names: tuple[str, ...]) -> list[str]:
    """Derived tables in order of need: those that a name's own SQL reads come first."""
    out: list[str] = []
    for name in names:
        for other in DERIVED_SQL:
            if other != name and f" {other} " in f" {DERIVED_SQL[name].replace(chr(10), ' ')} ":
                out += [x for x in _closure((other,)) if x not in out]
        if name not in out:
            out.append(name)
    return out
