"""All queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

from siltstone.plans import analysis, catalog, content, forensic, general, metrics

MODULES = (general, catalog, content, forensic, analysis, metrics)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
