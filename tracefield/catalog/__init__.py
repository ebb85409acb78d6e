"""Registered queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["text", "bytestats", "traffic", "carving", "raid", "txgraph", "strategy", "jobs", "container", "live", "sources"]


def _modules():
    return [importlib.import_module(f"tracefield.catalog.{m}") for m in MODULES]


def queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
