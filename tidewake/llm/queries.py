"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import decontamination, html_text, jaccard, language_model, licenses, merkle, pieces, quality, repeats, sharding, topk, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_model": language_model.op1_language_model,
    "op2_warc": warc.op2_warc,
    "op3_html": html_text.op3_html,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_pieces": pieces.op5_pieces,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_licenses": licenses.op7_licenses,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality": quality.op9_quality,
    "op10_topk": topk.op10_topk,
    "op11_repeats": repeats.op11_repeats,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op4_jaccard": jaccard.OP4_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op10_topk": topk.OP10_SQL,
    "op11_repeats": repeats.OP11_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
