"""Registered queries (name → DataFrame job) and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = [
    "relaylake.plans.q_intake",
    "relaylake.plans.q_stages",
    "relaylake.plans.q_approvals",
    "relaylake.plans.q_clarify",
    "relaylake.plans.q_quality",
    "relaylake.plans.q_ingest",
    "relaylake.plans.q_endpoints",
    "relaylake.plans.q_remediation",
    "relaylake.plans.q_streaming",
    "relaylake.plans.q_runlog",
    "relaylake.plans.q_lookup",
]


def _load(attr: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        merged.update(getattr(importlib.import_module(name), attr))
    return merged


def all_queries() -> dict:
    return _load("QUERIES")


def all_oracles() -> dict:
    return _load("ORACLE")
