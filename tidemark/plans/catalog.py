"""The registered queries of the evidence operators and their DuckDB oracles."""

from __future__ import annotations

from tidemark.plans import candidates, cases, checks, conditions, documents, evaluation, feeds, filings, integrity, ledgers, longitudinal, pointintime, roles, sampling, scoring  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

#: The names that these queries had when the plain ones read a part of their tables.
for _name in [n for n in QUERIES if n.endswith("_whole")]:
    ORACLES[_name] = ORACLES[_name.removesuffix("_whole")]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
