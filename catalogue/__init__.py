"""Registered queries: each name with its Spark callable and, where possible, the equivalent SQL."""

from __future__ import annotations


def registered() -> dict:
    from catalogue import architecture, mapping, stored, stress, usage, workload

    modules = (usage, mapping, architecture, stress, workload, stored)
    return {name: query for module in modules for name, query in module.QUERIES.items()}
