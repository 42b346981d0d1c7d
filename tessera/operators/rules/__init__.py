"""Detection rules as predicates over fact tables; see ``engine`` for the contract and the language modules for the catalogue."""

from .engine import Rule, evaluate, registry, rule_sql

__all__ = ["Rule", "evaluate", "registry", "rule_sql"]
