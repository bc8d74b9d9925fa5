"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, embeddings, minhash, packing, pii, sharding, substrings, toxicity, urlfilter, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_sharding": sharding.op2_sharding,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_urlfilter": urlfilter.op7_urlfilter,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_substrings": substrings.op9_substrings,
    "op10_pii": pii.op10_pii,
}
SQL = {
    "op1_minhash": minhash.OP1_SQL,
    "op3_decontamination": decontam.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_embeddings": embeddings.OP6_SQL,
    "op9_substrings": substrings.OP9_SQL,
}
