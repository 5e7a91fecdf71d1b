"""The opN queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import alignment, bpe, embedding_dedup, gif_media, jaccard_join, language, license_scan, line_dedup, packing, quality, toxicity, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_gif_media": gif_media.op5_gif_media,
    "op6_warc": warc.op6_warc,
    "op7_embedding_near_dedup": embedding_dedup.op7_embedding_near_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_language_id": language.op11_language_id,
    "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
}
ORACLES = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op7_embedding_near_dedup": embedding_dedup.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
}
