"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib

FAMILIES = ["tables", "rules", "scoring", "measures", "desk", "usage", "timeline", "search", "learning", "quality"]


def load():
    """All registered entries by key."""
    from paywarden.plans.registry import ENTRIES
    for family in FAMILIES:
        importlib.import_module(f"paywarden.plans.{family}")
    return ENTRIES
