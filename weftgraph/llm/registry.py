"""Queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from weftgraph.llm import decontamination, importance, jaccard, language_model, licenses, mixing, oracles, packing, periodic, pii, quality, substrings, suffixes, tokens

QUERIES = {
    "op1_pareto_mix": mixing.op1,
    "op2_substring_dedup": substrings.op2,
    "op3_decontamination": decontamination.op3,
    "op4_language_model": language_model.op4,
    "op5_token_output": tokens.op5,
    "op6_license_scan": licenses.op6,
    "op7_quality_rules": quality.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_suffix_dedup": suffixes.op9,
    "op10_personal_data": pii.op10,
    "op11_importance_resampling": importance.op11,
    "op12_packing": packing.op12,
    "op13_periodic_runs": periodic.op13,
}
#: The others have no SQL (tokenisers, automata, learned weights, binomial bounds): tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_pareto_mix": oracles.OP1,
    "op2_substring_dedup": oracles.OP2,
    "op7_quality_rules": oracles.OP7,
    "op8_jaccard_join": oracles.OP8,
    "op9_suffix_dedup": oracles.OP9,
    "op11_importance_resampling": oracles.OP11,
    "op13_periodic_runs": oracles.OP13,
}
