"""The subpackage's queries and their SQL."""

from __future__ import annotations

from satchel.llm import bpe, chat, decontaminate, fmdedup, jaccard, manifest, media, neardup, negatives, quality, sharding, suffixdedup, tokenstore

QUERIES = {
    "op1_suffix_array_dedup": suffixdedup.suffix_query,
    "op2_media_columns": media.media_query,
    "op3_sharding": sharding.sharding_query,
    "op4_substring_dedup": fmdedup.words_query,
    "op5_token_store": tokenstore.token_query,
    "op6_quality_classifier": quality.quality_query,
    "op7_byte_bpe": bpe.bpe_query,
    "op8_chat_formatting": chat.chat_query,
    "op9_minhash_near_dedup": neardup.near_query,
    "op10_decontamination": decontaminate.decontamination_query,
    "op11_hard_negatives": negatives.negatives_query,
    "op12_merkle_manifest": manifest.manifest_query,
    "op13_ngram_jaccard_join": jaccard.jaccard_query,
}

SQL = {
    "op11_hard_negatives": negatives.NEGATIVES_SQL,
    "op12_merkle_manifest": manifest.MANIFEST_SQL,
    "op8_chat_formatting": chat.CHAT_SQL,
    "op10_decontamination": decontaminate.DECONTAMINATION_SQL,
}
