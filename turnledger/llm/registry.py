"""The subpackage's queries and their SQL twins."""

from __future__ import annotations

from . import byte_bpe, decontamination, exact_dedup, feistel_shards, hard_negatives, license_scan, ngram_join, pii, quality, reply_trees, secret_scan, structure_repair, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_pii": pii.op2_pii,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_quality": quality.op5_quality,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_feistel_shards": feistel_shards.op7_feistel_shards,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_reply_trees": reply_trees.op11_reply_trees,
    "op12_structure_repair": structure_repair.op12_structure_repair,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {
    "op3_decontamination": decontamination.OP3_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_reply_trees": reply_trees.OP11_SQL,
    "op12_structure_repair": structure_repair.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
