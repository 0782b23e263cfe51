"""The training corpus from documents: five stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that the fertility rules reject go.
2. near_duplicates: one document of each near-duplicate class stays.
3. pii: personal data is replaced by its kind in brackets.
4. mix: each source's documents are repeated or left out until its words come near its target.
5. pack: the documents' token pieces are packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import fertility, mixing, packing, pii, shingles
from tickloom.llm.common import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the documents that neither the base rules nor the fertility bands reject."""
    return fertility.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose five-word shingles have a Jaccard similarity of 0.8 or more: that with the least doc_id.

    Operator 1's covering SimHash tables give the pairs that differ in two bits or fewer, which few pairs at 0.8 do; bands of MinHash values give the rest.
    """
    return shingles.keep_one(docs, words=5, least=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: texts with personal data replaced, n_chars to match."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packing.pack(docs, capacity=4096, end_id=1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mix", mix), ("pack", pack)]

#: The stages use tokenisers and a trained model, which SQL cannot express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what lies between them is Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs
