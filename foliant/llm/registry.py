"""The queries of this subpackage by name, and DuckDB SQL where SQL can say what they compute."""

from __future__ import annotations

from foliant.llm import chat, decontam, divergence, langid, mixing, pii, quality, runs, secrets, simhash, substrings, suffixes, warc

QUERIES = {
    "op1_pigeonhole_myers": decontam.op1,
    "op2_merkle_fixity": warc.op2,
    "op3_cube_mixing": mixing.op3,
    "op4_schema_fingerprint": chat.op4,
    "op5_prefix_doubling": suffixes.op5,
    "op6_bootstrapped_context": pii.op6,
    "op7_markov_secrets": secrets.op7,
    "op8_suffix_repetition": quality.op8,
    "op9_simhash_multi_index": simhash.op9,
    "op10_language_bitmask": langid.op10,
    "op11_fm_matching": substrings.op11,
    "op12_bounded_term_search": divergence.op12,
    "op13_lyndon_runs": runs.op13,
}

ORACLE_SQL: dict[str, str] = {"op2_merkle_fixity": warc.OP2_SQL, "op11_fm_matching": substrings.OP11_SQL, "op12_bounded_term_search": divergence.OP12_SQL}
