"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, exact_dedup, jaccard_join, language_id, lm_scoring, packing, quality, repeats, secret_scans, toxicity

QUERIES = {
    "op1_lm_scoring": lm_scoring.query, "op2_toxicity": toxicity.query, "op3_jaccard_join": jaccard_join.query, "op4_best_fit_packing": packing.query, "op5_decontamination": decontamination.query,
    "op6_repeats": repeats.query, "op7_exact_dedup": exact_dedup.query, "op8_secret_scans": secret_scans.query, "op9_quality": quality.query, "op10_language_id": language_id.query,
}
SQL = {"op5_decontamination": decontamination.SQL, "op7_exact_dedup": exact_dedup.SQL}
