"""Registered queries over the given tables."""

from talweg.plans import archives, composed, evaluation, governance, roles, rules
from talweg.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "archives", "composed", "evaluation", "governance", "roles", "rules"]
