"""The registered queries."""

import importlib

from corvane.plans.registry import ORACLE_SQL, QUERIES

for _module in ("usage", "texts", "documents", "support", "learning", "registers", "streams"):
    importlib.import_module(f"corvane.plans.{_module}")

__all__ = ["ORACLE_SQL", "QUERIES"]
