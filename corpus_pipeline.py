"""The corpus pipeline: five of the corpus operators, one after the other, over the whole documents table.

Each stage's result is written to the shared folder as Parquet and read again as the next one's documents, so a lost
executor costs a stage at most. Stages keep every row but those they reject: quality rules drop documents that fail (and failing lines
of the others), line dedup drops later lines, SimHash keeps one document of each group, decontamination drops documents
with a benchmark passage, and the last stage adds token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervalia.llm import bpe_codec, decontamination, line_dedup, quality_rules, simhash
from intervalia.llm.common import Scratch, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash", simhash.stage),
    ("decontamination", decontamination.stage),
    ("bpe_encoding", bpe_codec.stage),
]

#: Fingerprints, latent retrieval and byte-pair merges can't be written as SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
