"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from loomgraph.llm import (
    decontaminate,
    html_extract,
    line_dedup,
    near_dedup,
    packing,
    pii,
    prefix_trie,
    quality_rules,
    secret_scan,
    sharding,
    token_alignment,
    toxicity,
    warc,
)


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_pii": pii.op6_pii,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_sharding": sharding.op8_sharding,
        "op9_secret_scan": secret_scan.op9_secret_scan,
        "op10_html_extraction": html_extract.op10_html_extraction,
        "op11_conversation_trie": prefix_trie.op11_conversation_trie,
        "op12_warc": warc.op12_warc,
        "op13_token_alignment": token_alignment.op13_token_alignment,
    }


def oracle_sql() -> dict:
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op2_decontamination": decontaminate.OP2_SQL,
        "op4_line_dedup": line_dedup.OP4_SQL,
        "op5_near_dedup": near_dedup.OP5_SQL,
        "op8_sharding": sharding.OP8_SQL,
        "op9_secret_scan": secret_scan.OP9_SQL,
        "op11_conversation_trie": prefix_trie.OP11_SQL,
        "op12_warc": warc.OP12_SQL,
    }
