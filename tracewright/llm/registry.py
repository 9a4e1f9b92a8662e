"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, divergence, exact_dedup, line_dedup, lm_score, near_dedup, packing, pii, simhash, suffix_dedup, token_counts, toxicity, whitening

QUERIES = {f.__name__: f for f in (pii.op1_pii, line_dedup.op2_line_dedup, packing.op3_pack, suffix_dedup.op4_suffix_dedup, near_dedup.op5_minhash, lm_score.op6_lm_score, exact_dedup.op7_exact_dedup, decontaminate.op8_decontaminate, toxicity.op9_toxicity, token_counts.op10_token_counts, whitening.op11_whitening, divergence.op12_divergence, simhash.op13_simhash)}
SQL = {"op2_line_dedup": line_dedup.SQL, "op4_suffix_dedup": suffix_dedup.SQL, "op5_minhash": near_dedup.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_decontaminate": decontaminate.SQL, "op12_divergence": divergence.SQL}
