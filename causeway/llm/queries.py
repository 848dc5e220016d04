"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from causeway.llm import chat, ctw, fingerprints, infill, linededup, mixing, neardup, packing, phrases, quality, sharding, urlfilter, vectors

QUERIES = {
    "op1_minhash_neardup": neardup.query,
    "op2_line_dedup": linededup.query,
    "op3_packing": packing.query,
    "op4_embedding_range_join": vectors.query,
    "op5_quality_rules": quality.query,
    "op6_size_tiered_sharding": sharding.query,
    "op7_context_tree_weighting": ctw.query,
    "op8_transcript_roles": chat.query,
    "op9_curriculum_mixing": mixing.query,
    "op10_piecewise_fingerprints": fingerprints.query,
    "op11_fill_in_middle": infill.query,
    "op12_url_filter": urlfilter.query,
    "op13_phrase_collocations": phrases.query,
}

ORACLES = {
    "op2_line_dedup": linededup.SQL,
    "op4_embedding_range_join": vectors.SQL,
    "op9_curriculum_mixing": mixing.SQL,
    "op11_fill_in_middle": infill.SQL,
    "op12_url_filter": urlfilter.SQL,
    "op13_phrase_collocations": phrases.SQL,
}
