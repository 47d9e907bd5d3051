"""Loads every module that registers a query."""

from __future__ import annotations

import importlib

from weekcell.llm.registry import ORACLES, QUERIES

MODULES = ["sharding", "token_files", "pieces", "toxicity", "languages", "quality", "ngram_join", "decontamination", "lm_score",
           "html_extraction", "periodic_runs", "source_audit",
           "licenses"]

for module in MODULES:
    importlib.import_module(f"weekcell.llm.{module}")

__all__ = ["ORACLES", "QUERIES"]
