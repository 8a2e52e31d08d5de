"""All registered queries of the engine itself, and their SQL."""

from __future__ import annotations

from siltstone.plans import ablation, analytics, ranked, reasoning, reports

MODULES = (ranked, analytics, reasoning, ablation, reports)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
