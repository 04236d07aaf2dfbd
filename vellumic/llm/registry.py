"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import leakage, lookalike, mixing, ocr_noise, percentiles, pii, subjects

MODULES = [percentiles, lookalike, ocr_noise, pii, leakage, mixing, subjects]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
