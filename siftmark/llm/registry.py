"""The queries of this package and their SQL."""

from __future__ import annotations

from . import binary_ids, conversations, fingerprints, jaccard, language_model, licenses, packing, pieces, quality, rollups, secrets, sharding, whitening

QUERIES = {
    f.__name__: f
    for f in (
        pieces.op1_sentencepiece,
        packing.op2_packing,
        quality.op3_quality_rules,
        binary_ids.op4_token_binary,
        language_model.op5_lm_scoring,
        licenses.op6_license_scan,
        secrets.op7_secret_scan,
        rollups.op8_token_counts,
        fingerprints.op9_document_fingerprints,
        jaccard.op10_ngram_jaccard,
        conversations.op11_conversation_trie,
        sharding.op12_sharding,
        whitening.op13_whitening,
    )
}
ORACLES = {"op3_quality_rules": quality.OP3_SQL, "op11_conversation_trie": conversations.OP11_SQL, "op12_sharding": sharding.op12_sql()}
