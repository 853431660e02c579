"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, exact_dedup, html_text, langid, licenses, media, near_dedup, packing, quality, repeats, sstable, variants, whitening

OPERATORS = (
    packing.op1_best_fit_packing,
    media.op2_media_columns,
    sstable.op3_token_shards,
    langid.op4_language_id,
    licenses.op5_license_scan,
    exact_dedup.op6_exact_dedup,
    near_dedup.op7_minhash,
    html_text.op8_main_text,
    repeats.op9_repeats,
    bpe.op10_bpe,
    whitening.op11_whitening,
    quality.op12_quality_rules,
    variants.op13_spelling_variants,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.SQL, "op12_quality_rules": quality.SQL}
