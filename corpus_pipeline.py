"""From raw documents to token ids: five stages, each over all that the one before kept.

All stages take null, empty and very long texts, null and repeated ids, repeated
rows, empty tables and extra columns of any name; all but the last return the
columns that they were given. What a stage does with such rows its function says.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from visitloom.llm import bpe, decontaminate, quality, secrets, simhash
from visitloom.llm.common import table
from visitloom.sources.staging import stage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; empty texts are judged like others, null ids make no difference."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose 4-word SimHashes link at 4 or fewer differing bits the smallest id stays.

    Null, empty and wordless texts are one group. A null id is never the
    smallest unless a group has no other; of equal ids one row stays.
    """
    return simhash.keep_first(docs, width=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a benchmark covers a twentieth or more go; texts without words stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay, null texts as they are."""
    return secrets.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the bytes decoded from them.

    A null text has the ids of an empty one: none. Every row stays.
    """

    def derive(encoder: bpe.Encoder, ids: list[int], decoded: bytes) -> tuple:
        listed = ",".join(map(encoder.names.__getitem__, ids)).encode()
        return ids, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()

    types = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    encoded = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), types, derive)
    return encoded.select("doc_id", "lang", "source", *types)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: The rule ensemble, SimHash components and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
