"""Registry of named queries and their DuckDB oracle SQL.

A query is ``(spark, sf_dir) -> DataFrame``; its result has every float
rounded to 4 places so it can be compared value-for-value with the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.functions.columns import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
_ROUND = re.compile(r"\bround\(", re.IGNORECASE)


def expand_rounding(sql: str) -> str:
    """Rewrite ``round(e, d)`` to ``floor((e)*1e{d}+5e-1)/1e{d}`` (see round_half_up)."""
    out, i = [], 0
    while True:
        m = _ROUND.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:m.start()])
        depth, j = 1, m.end()
        last_comma = None
        while depth:
            ch = sql[j]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                last_comma = j
            j += 1
        if last_comma is None:
            out.append(sql[m.start():j])
        else:
            expr = expand_rounding(sql[m.end():last_comma])
            d = int(sql[last_comma + 1:j - 1].strip())
            out.append(f"(floor(({expr})*1e{d}+5e-1)/1e{d})")
        i = j


ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, digits: int = 4):
    """Decorator: register a query under ``name`` with optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), digits)

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = expand_rounding(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register themselves."""
    from larder.plans import retail, demand, support, chat, agentlog, retrieval  # noqa: F401
