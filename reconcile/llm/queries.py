"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, binary_codes, hamming_join, licences, merkle, mixing, periodic_runs, pii_crf, stream_dedup, string_kernel, syncmers, unit_dedup, url_trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_crf": pii_crf.query,
    "op2_syncmer_fingerprints": syncmers.query,
    "op3_minhash_hamming_join": hamming_join.query,
    "op4_url_trees": url_trees.query,
    "op5_string_kernel_language": string_kernel.query,
    "op6_best_fit_packing": best_fit.query,
    "op7_unit_dedup": unit_dedup.query,
    "op8_source_mixing": mixing.query,
    "op9_licence_scan": licences.query,
    "op10_stateful_exact_dedup": stream_dedup.query,
    "op11_merkle_manifest": merkle.query,
    "op12_multi_index_hashing": binary_codes.query,
    "op13_periodic_runs": periodic_runs.query,
}

#: The others depend on trained models, tokenizers or iteration; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op8_source_mixing": mixing.ORACLE,
    "op10_stateful_exact_dedup": stream_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
}
