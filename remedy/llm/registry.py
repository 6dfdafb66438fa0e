"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op1_brown",
    "op2_warc",
    "op3_mixing",
    "op4_html",
    "op5_toxicity",
    "op6_sharding",
    "op7_langid",
    "op8_decontaminate",
    "op9_simhash",
    "op10_vptree",
    "op11_align",
    "op12_packing",
    "op13_trie",
)

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _mod = import_module(f"remedy.llm.{_name}")
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(getattr(_mod, "ORACLE", {}))
