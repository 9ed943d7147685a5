"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from corpuloom.llm.bpe import op6_bpe
from corpuloom.llm.embedding_dedup import op2_embedding_dedup
from corpuloom.llm.kneser_ney import op9_quality_lm
from corpuloom.llm.language_id import op7_language_id
from corpuloom.llm.license_scan import OP1_SQL, op1_license_scan
from corpuloom.llm.minhash_dedup import op3_minhash_dedup
from corpuloom.llm.mixing import op10_mixing
from corpuloom.llm.permutation_index import op13_permutation_index
from corpuloom.llm.quality_rules import OP4_SQL, op4_quality_rules
from corpuloom.llm.spelling import OP12_SQL, op12_spelling_variants
from corpuloom.llm.token_store import op5_token_store
from corpuloom.llm.toxicity import op8_toxicity
from corpuloom.llm.whitening import op11_whitening


def queries() -> dict:
    ops = (
        op1_license_scan,
        op2_embedding_dedup,
        op3_minhash_dedup,
        op4_quality_rules,
        op5_token_store,
        op6_bpe,
        op7_language_id,
        op8_toxicity,
        op9_quality_lm,
        op10_mixing,
        op11_whitening,
        op12_spelling_variants,
        op13_permutation_index,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict:
    return {"op1_license_scan": OP1_SQL, "op4_quality_rules": OP4_SQL, "op12_spelling_variants": OP12_SQL}
