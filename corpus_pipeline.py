"""Corpus pipeline: toxicity, line dedup, MinHash near-dedup, decontamination, BPE.

Each stage works on all that its predecessor kept.  Those before the last
return the columns of documents; the last returns the digests of the ids and of
the decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from karstline.llm import bpe, decontaminate, linededup, minhash, toxicity
from karstline.llm.common import checkpoint

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", linededup.stage),
    ("near-dedup", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("byte-level BPE", bpe.stage),
]

#: SQL can express neither the votes nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
