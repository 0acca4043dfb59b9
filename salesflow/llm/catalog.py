"""Every query of this subpackage by name, and SQL texts for those that SQL can express."""

from collections.abc import Callable

from salesflow.llm import op1_bpe, op2_repeats, op3_secrets, op4_fingerprints, op5_tokens, op6_toxicity, op7_pii, op8_jaccard, op9_quality, op10_packing, op11_quality, op12_divergence, op13_whitening


def queries() -> dict[str, Callable]:
    return {
        "op1_bpe_roundtrip": op1_bpe.op1_bpe_roundtrip,
        "op2_repeat_removal": op2_repeats.op2_repeat_removal,
        "op3_secret_scan": op3_secrets.op3_secret_scan,
        "op4_fingerprints": op4_fingerprints.op4_fingerprints,
        "op5_token_counts": op5_tokens.op5_token_counts,
        "op6_toxicity": op6_toxicity.op6_toxicity,
        "op7_pii": op7_pii.op7_pii,
        "op8_jaccard_join": op8_jaccard.op8_jaccard_join,
        "op9_quality_rules": op9_quality.op9_quality_rules,
        "op10_best_fit_packing": op10_packing.op10_best_fit_packing,
        "op11_quality_classifier": op11_quality.op11_quality_classifier,
        "op12_source_divergence": op12_divergence.op12_source_divergence,
        "op13_embedding_whitening": op13_whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_jaccard_join": op8_jaccard.SQL, "op12_source_divergence": op12_divergence.SQL}
