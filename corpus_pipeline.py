"""A corpus pipeline over ``documents``: five stages, each one operator on all that the stage before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
result to the shared folder as Parquet and reads it back for the next stage, so a lost
executor never costs more than the stage at hand.  A stage's intermediate tables go when
its result is written, and its input when the next stage has read it.  All but the last
stage return the columns of ``documents``.

Defined results, for every stage: null texts count as empty (quality rules reject them);
nulls in other columns are kept as they are, null sources being one source; repeated rows
are documents of their own until near-duplicate removal keeps one; other columns of
``documents``, whatever their names, come along up to the last stage; an empty table
gives an empty table; texts are handled whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depthline.llm import mixing, order_minhash, pii, quality_rules, sentence_pieces
from depthline.llm.common import Scratch, stored
from depthline.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.cascade(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return order_minhash.deduplicate(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return pii.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights; a document is there as often as the mix takes it."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as ids, with a check that they decode to its text."""
    return sentence_pieces.piece_report(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_stage), ("minhash_near_dedup", dedup_stage), ("pii", pii_stage), ("mixing", mix_stage), ("sentencepiece", token_stage)]

#: The near-duplicate and trained stages cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = Scratch(spark)
    for name, stage in STAGES[:-1]:
        after = Scratch(spark)
        with Scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", after)
        before.close()
        before = after
    name, stage = STAGES[-1]
    with Scratch(spark) as scratch:
        docs = scratch.result(stage(spark, docs, sf_dir), f"stage-{name}")
    before.close()
    return docs
