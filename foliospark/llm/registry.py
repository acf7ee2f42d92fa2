"""Queries of this package and their SQL; a query without SQL is tested against brute force in tests/llm."""

from foliospark.llm import bpe, exact_dedup, fingerprints, language, line_dedup, mixing, near_dedup, sharding, substring_dedup, suffix_array_dedup

QUERIES = {
    "op1_merkle_fingerprints": fingerprints.op1_merkle_fingerprints,
    "op2_feistel_sharding": sharding.op2_feistel_sharding,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_bpe_codec": bpe.op5_bpe_codec,
    "op6_language_id": language.op6_language_id,
    "op7_suffix_array_dedup": suffix_array_dedup.op7_suffix_array_dedup,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_merkle_fingerprints": fingerprints.SQL,
    "op2_feistel_sharding": sharding.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op7_suffix_array_dedup": suffix_array_dedup.SQL,
    "op8_minhash_near_dedup": near_dedup.SQL,
    "op9_mixing": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
