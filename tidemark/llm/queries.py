"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import cross_tokens, decontamination, edit_fingerprint, jaccard_join, language_id, main_text, mixing, resampling, secrets, sharding, token_counts, toxicity, warc

QUERIES = {
    "op1_edit_fingerprint": edit_fingerprint.op1_edit_fingerprint,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_rendezvous_sharding": sharding.op3_rendezvous_sharding,
    "op4_language_id": language_id.op4_language_id,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_mixing": mixing.op6_mixing,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_warc": warc.op8_warc,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_cross_tokens": cross_tokens.op11_cross_tokens,
    "op12_main_text": main_text.op12_main_text,
    "op13_resampling": resampling.op13_resampling,
}

ORACLES = {
    "op3_rendezvous_sharding": sharding.ORACLE,
    "op8_warc": warc.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
