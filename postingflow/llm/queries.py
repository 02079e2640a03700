"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, line_dedup, maxent, media_chunks, packing, pieces, toxicity, training_order, warc

QUERIES = {
    "op1_media_chunks": media_chunks.query,
    "op2_maxent": maxent.query,
    "op3_pieces": pieces.query,
    "op4_packing": packing.query,
    "op5_toxicity": toxicity.query,
    "op6_line_dedup": line_dedup.query,
    "op7_warc": warc.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_training_order": training_order.query,
    "op10_exact_dedup": exact_dedup.query,
}

ORACLE_SQL = {
    "op6_line_dedup": line_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
