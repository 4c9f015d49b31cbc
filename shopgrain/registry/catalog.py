"""All registered queries in one place."""

from __future__ import annotations

import importlib

SUBJECTS = ("customers", "sales", "quality", "segments", "cohorts", "fraud", "hypothesis", "models", "given", "sources")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in SUBJECTS:
    _m = importlib.import_module(f".{_name}", __package__)
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
