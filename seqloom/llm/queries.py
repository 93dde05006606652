"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import extract, langid, mixing, packing, quality, secrets, simhash, tokens, topk, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_extract": extract.op2_extract,
    "op3_tokens": tokens.op3_tokens,
    "op4_secrets": secrets.op4_secrets,
    "op5_quality": quality.op5_quality,
    "op6_pack": packing.op6_pack,
    "op7_topk": topk.op7_topk,
    "op8_langid": langid.op8_langid,
    "op9_mix": mixing.op9_mix,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op7_topk": topk.OP7_SQL,
    "op9_mix": mixing.OP9_SQL,
}
