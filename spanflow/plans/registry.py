"""Registry: query name -> Spark builder ``(spark, sf_dir) -> DataFrame`` and
its DuckDB SQL twin."""

from __future__ import annotations

from typing import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all_plans():
    from . import (q_code, q_dataflow, q_flow, q_grammar, q_kernel, q_lists, q_structure,  # noqa: F401  (registration)
                   q_tokens, q_vectors)
    return QUERIES, ORACLE
