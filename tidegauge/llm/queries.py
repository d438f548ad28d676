"""Importing this module registers the query of every operator."""

from __future__ import annotations

import importlib

MODULES = ["q1_quality", "q2_licenses", "q3_warc", "q4_toxicity", "q5_decontamination", "q6_token_counts", "q7_jaccard", "q8_mixing", "q9_token_files", "q10_substrings", "q11_periodic_runs", "q12_window_trees", "q13_vector_codes"]


def load():
    for name in MODULES:
        importlib.import_module(f"tidegauge.llm.{name}")
    from tidegauge.llm.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
