"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from karstline.llm import bpe, decontaminate, fixity, hpylm, htmlcrf, licenses, linededup, minhash, topk, toxicity

MODULES = (hpylm, topk, htmlcrf, licenses, fixity, toxicity, linededup, minhash, decontaminate, bpe)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
