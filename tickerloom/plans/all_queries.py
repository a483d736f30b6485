"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

MODULES = (
    "domain_tables",
    "q_indicators",
    "q_fundamentals",
    "q_relational",
    "q_portfolio",
    "q_scalars",
    "q_quality",
    "q_ml",
    "q_streaming",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tickerloom.plans.{name}")
