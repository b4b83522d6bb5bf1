"""The queries of this subpackage and the SQL that says the same, for __spark_entry__.py."""

from __future__ import annotations

from talkweave.llm import bpe, conversations, embedding_dedup, filter_audit, html_extract, license_scan, lm_scoring, packing, quality_rules, sharding, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_bpe": bpe.op3_bpe,
    "op4_simhash": simhash.op4_simhash,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_packing": packing.op7_packing,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_conversations": conversations.op11_conversations,
    "op12_sharding": sharding.op12_sharding,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op2_license_scan": license_scan.ORACLE_SQL,
    "op11_conversations": conversations.ORACLE_SQL,
    "op12_sharding": sharding.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
