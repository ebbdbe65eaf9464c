"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from versefold.llm.oracles import ORACLES
from versefold.session import ship

#: Query name -> module and function here.
QUERIES = {
    "op1_fingerprints": ("fingerprints", "op1"),
    "op2_chat": ("chat", "op2"),
    "op3_decontamination": ("decontamination", "op3"),
    "op4_maxent_lm": ("maxent", "op4"),
    "op5_sharding": ("sharding", "op5"),
    "op6_wrappers": ("wrappers", "op6"),
    "op7_mixing": ("mixing", "op7"),
    "op8_jaccard_join": ("jaccard", "op8"),
    "op9_quality": ("quality", "op9"),
    "op10_id_store": ("id_store", "op10"),
}


def queries() -> dict:
    def shipped(f):
        return wraps(f)(lambda spark, sf_dir: f(ship(spark), sf_dir))

    out = {name: shipped(getattr(import_module(f"versefold.llm.{module}"), function)) for name, (module, function) in QUERIES.items()}
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | out


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
