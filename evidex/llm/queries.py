"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import centroids, chat, compact, embdedup, langid, mixing, neardup, packing, secrets, suffix, topk, trie, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_topk": topk.op1,
        "op2_suffix": suffix.op2,
        "op3_compact": compact.op3,
        "op4_langid": langid.op4,
        "op5_packing": packing.op5,
        "op6_secrets": secrets.op6,
        "op7_mixing": mixing.op7,
        "op8_neardup": neardup.op8,
        "op9_warc": warc.op9,
        "op10_embeddings": embdedup.op10,
        "op11_trie": trie.op11,
        "op12_chat": chat.op12,
        "op13_centroids": centroids.op13,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.OP1_SQL, "op7_mixing": mixing.OP7_SQL, "op9_warc": warc.OP9_SQL, "op11_trie": trie.OP11_SQL, "op12_chat": chat.OP12_SQL, "op13_centroids": centroids.OP13_SQL}
