"""Registered queries over the driver's tables."""

from lexloom.plans.inputs import TABLES
from lexloom.plans.registry import ORACLES, QUERIES
from lexloom.plans import canonical_plans, corpus_plans, evaluate_plans, io_plans, policy_plans, retrieval_plans, rule_plans, text_plans, vocab_plans  # noqa: F401

__all__ = ["ORACLES", "QUERIES", "TABLES"]
