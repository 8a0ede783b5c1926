"""The opN queries and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ("hamming", "quality_model", "quality_rules", "packing", "near_dups", "class_lm", "token_store", "url_cascade", "lexicon", "chat")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
