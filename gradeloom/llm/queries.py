"""The registered corpus queries and, where SQL can say them, their twins."""

from __future__ import annotations

from .common import table
from . import ann, bpe, chat, divergence, fingerprints, language, packing, pii, quality, simhash, spelling, toxicity, warc

QUERIES = {
    "op1_pii": lambda spark, sf: pii.op1(table(spark, sf, "documents")),
    "op2_simhash": lambda spark, sf: simhash.op2(table(spark, sf, "documents")),
    "op3_toxicity": lambda spark, sf: toxicity.op3(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op4_language": lambda spark, sf: language.op4(table(spark, sf, "documents")),
    "op5_quality": lambda spark, sf: quality.op5(table(spark, sf, "documents")),
    "op6_packing": lambda spark, sf: packing.pack_documents(table(spark, sf, "documents")),
    "op7_ann": lambda spark, sf: ann.op7(table(spark, sf, "embeddings")),
    "op8_bpe": lambda spark, sf: bpe.op8(table(spark, sf, "documents")),
    "op9_chat": lambda spark, sf: chat.op9(table(spark, sf, "conversations")),
    "op10_warc": lambda spark, sf: warc.op10(table(spark, sf, "pages")),
    "op11_divergence": lambda spark, sf: divergence.op11(table(spark, sf, "documents")),
    "op12_spelling": lambda spark, sf: spelling.op12(table(spark, sf, "documents")),
    "op13_fingerprints": lambda spark, sf: fingerprints.op13(table(spark, sf, "documents")),
}

ORACLE: dict[str, str] = {
    "op9_chat": chat.oracle(),
    "op10_warc": warc.oracle(),
    "op11_divergence": divergence.oracle(),
    "op12_spelling": spelling.oracle(),
}
