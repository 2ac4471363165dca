"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

_OPS = {
    "op1_source_mix": "mixing",
    "op2_attention_quality": "attention_quality",
    "op3_kneser_ney_toxicity": "kneser_ney",
    "op4_substring_dedup": "substring_dedup",
    "op5_lexical_packing": "lexical_packing",
    "op6_line_frequency": "quality_rules",
    "op7_embedding_pigeonhole": "embedding_dedup",
    "op8_probminhash_dedup": "probminhash",
    "op9_token_files": "token_files",
    "op10_warc_archive": "warc",
    "op11_source_divergence": "divergence",
    "op12_lyndon_runs": "periodic_runs",
    "op13_sampled_shards": "sharding",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tidemark.llm.{m}"), name) for name, m in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import divergence, embedding_dedup, quality_rules, sharding, substring_dedup, warc

    return {
        "op4_substring_dedup": substring_dedup.OP4_SQL,
        "op6_line_frequency": quality_rules.OP6_SQL,
        "op7_embedding_pigeonhole": embedding_dedup.OP7_SQL,
        "op10_warc_archive": warc.OP10_SQL,
        "op11_source_divergence": divergence.OP11_SQL,
        "op13_sampled_shards": sharding.OP13_SQL,
    }
