"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillframe.llm import bpe, exact_dedup, gnat, html_content, language_model, lattice, minhash, mixing, multiset, secrets, threshold, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_log_bilinear": language_model.query,
    "op2_secret_scan": secrets.query,
    "op3_lattice_near_dup": lattice.query,
    "op4_tensored_minhash": minhash.query,
    "op5_bpe_prefix_dp": bpe.query,
    "op6_source_mix": mixing.query,
    "op7_html_message_passing": html_content.query,
    "op8_token_counts": token_counts.query,
    "op9_counterfactual_toxicity": toxicity.query,
    "op10_content_sort": exact_dedup.query,
    "op11_gnat_codes": gnat.query,
    "op12_multiset_fingerprint": multiset.query,
    "op13_threshold_clusters": threshold.query,
}

ORACLES: dict[str, str] = {
    "op10_content_sort": exact_dedup.ORACLE,
    "op11_gnat_codes": gnat.ORACLE,
    "op13_threshold_clusters": threshold.ORACLE,
}
