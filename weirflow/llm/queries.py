"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, langid, linededup, ngram_join, packing, quality, secrets, sharding, tokenid, toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": langid.query,
    "op2_sharding": sharding.query,
    "op3_toxicity": toxicity.query,
    "op4_token_ids": tokenid.query,
    "op5_best_fit_packing": packing.query,
    "op6_quality_rules": quality.query,
    "op7_decontamination": decontam.query,
    "op8_line_dedup": linededup.query,
    "op9_secret_scans": secrets.query,
    "op10_ngram_jaccard_join": ngram_join.query,
    "pipeline": pipeline,
}

SQL = {
    "op2_sharding": sharding.SQL,
    "op7_decontamination": decontam.SQL,
    "op8_line_dedup": linededup.SQL,
    "op10_ngram_jaccard_join": ngram_join.SQL,
}
