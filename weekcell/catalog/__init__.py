"""Registered queries over the given tables, by operator family."""

from __future__ import annotations

import importlib

FAMILIES = ["scans", "scalars", "space", "relational", "times", "models", "serving", "profiles", "streams"]


def load_catalog() -> None:
    for family in FAMILIES:
        importlib.import_module(f"weekcell.catalog.{family}")
