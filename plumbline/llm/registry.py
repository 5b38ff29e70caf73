"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from plumbline.llm import bpe, decontaminate, embeddings, langid, negatives, passages, pii, prefixes, quality, repair, secrets, sharding, simhash

QUERIES = {
    "op1_language": langid.op1_language,
    "op2_quality": quality.op2_quality,
    "op3_bpe": bpe.op3_bpe,
    "op4_pii": pii.op4_pii,
    "op5_sharding": sharding.op5_sharding,
    "op6_passages": passages.op6_passages,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_simhash": simhash.op9_simhash,
    "op10_secrets": secrets.op10_secrets,
    "op11_negatives": negatives.op11_negatives,
    "op12_tokens": prefixes.op12_tokens,
    "op13_repair": repair.op13_repair,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_embeddings": embeddings.OP8_SQL,
    "op11_negatives": negatives.OP11_SQL,
    "op13_repair": repair.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
