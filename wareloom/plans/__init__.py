"""Runnable queries over the driver tables, one module per operator family."""

from __future__ import annotations

from wareloom.plans.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
