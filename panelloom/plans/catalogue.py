"""All registered queries of the panel operators, with their SQL."""

from __future__ import annotations

from panelloom.plans import audits, decisions, more, panel, sweeps, text
from panelloom.plans.registry import Query

_PARTS = (panel.R, text.R, decisions.R, more.R, audits.R, sweeps.R)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.sql.items()}
