"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from tidewater.llm import ann, bpe, chat, exact_dedup, jaccard_join, license_scan, packing, quality, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_toxicity": toxicity.query,
    "op3_license_scan": license_scan.query,
    "op4_ann": ann.query,
    "op5_jaccard_join": jaccard_join.query,
    "op5_jaccard_links": jaccard_join.links_query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_packing": packing.query,
    "op8_chat": chat.query,
    "op9_quality": quality.query,
    "op10_warc": warc.query,
}
ORACLE = {
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op5_jaccard_links": jaccard_join.LINKS_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_chat": chat.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}
