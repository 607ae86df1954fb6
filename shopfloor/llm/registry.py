"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from shopfloor.llm import (chat, decontaminate, exact_dedup, fim, hpylm, html_extract, near_dup, pieces, pii,
                           prefix_trie, suffix_dedup, toxicity, warc)


def queries() -> dict:
    return {
        "op1_hpylm_score": hpylm.op1_hpylm_score,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_warc_zip": warc.op4_warc_zip,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_style_tree": html_extract.op6_style_tree,
        "op7_lsh_forest": near_dup.op7_lsh_forest,
        "op8_gumbel_pieces": pieces.op8_gumbel_pieces,
        "op9_prefix_targets": chat.op9_prefix_targets,
        "op10_feistel_pii": pii.op10_feistel_pii,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_piece_table": fim.op12_piece_table,
        "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.ORACLE,
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op4_warc_zip": warc.ORACLE,
        "op9_prefix_targets": chat.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_piece_table": fim.ORACLE,
        "op13_suffix_dedup": suffix_dedup.ORACLE,
    }
