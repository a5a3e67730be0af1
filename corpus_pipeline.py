"""From raw documents to packed training sequences: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import decontamination, packing, pii, quality, simhash
from tillroll.llm.common import table, written

STAGES = [
    ("quality", quality.keep_good),
    ("near_duplicates", simhash.keep_first),
    ("decontamination", decontamination.keep_clean),
    ("personal_data", pii.mask),
    ("packing", packing.pack_documents),
]

#: Learned labels, hashes of 64 bits and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
