"""The registered queries: name -> (callable, DuckDB SQL or None), one module per operator family."""

from __future__ import annotations

from lexiforge.plans import retrieval_queries, text_queries

_FAMILIES = [retrieval_queries, text_queries]


def queries() -> dict:
    return {name: run for family in _FAMILIES for name, (run, _) in family.CATALOGUE.items()}


def oracles() -> dict:
    return {name: sql for family in _FAMILIES for name, (_, sql) in family.CATALOGUE.items() if sql is not None}
