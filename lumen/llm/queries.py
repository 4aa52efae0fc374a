"""The training-data queries: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from . import decontamination, jaccard_join, language_id, manifest, packing, pii, prefix_trie, quality, secret_scan, sharding, suffix_dedup, topk, toxicity


def queries() -> dict:
    return {
        "op1_quality": quality.query,
        "op2_language_id": language_id.query,
        "op3_packing": packing.query,
        "op4_topk": topk.query,
        "op5_suffix_dedup": suffix_dedup.query,
        "op6_pii": pii.query,
        "op7_jaccard_join": jaccard_join.query,
        "op8_decontamination": decontamination.query,
        "op9_toxicity": toxicity.query,
        "op10_sharding": sharding.query,
        "op11_manifest": manifest.query,
        "op12_secret_scan": secret_scan.query,
        "op13_prefix_trie": prefix_trie.query,
    }


def oracle_sql() -> dict:
    return {
        "op4_topk": topk.oracle(),
        "op8_decontamination": decontamination.oracle(),
        "op10_sharding": sharding.oracle(),
        "op11_manifest": manifest.oracle(),
        "op13_prefix_trie": prefix_trie.oracle(),
    }
