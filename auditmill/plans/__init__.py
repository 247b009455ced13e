"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from auditmill.plans import graph_and_stream, reports, site_audit, training_data

_MODULES = [training_data, site_audit, graph_and_stream, reports]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracles() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.ORACLES
    return out
