"""Query plans: every registered query and its oracle SQL."""

from __future__ import annotations

from lotwise.plans import q_inventory, q_logistics, q_models, q_rules  # noqa: F401  (registers queries)
from lotwise.plans.registry import REGISTRY


def queries():
    return {name: r.build for name, r in REGISTRY.items()}


def oracle_sql():
    return {name: r.sql for name, r in REGISTRY.items() if r.sql}
