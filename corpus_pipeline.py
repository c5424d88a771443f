"""A corpus in five stages, each over all that its predecessor kept: language ID, n-gram Jaccard join,
benchmark decontamination, secret scans, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.llm.common import remove, scratch, stored, table
from proofset.llm.decontaminate import remove_contamination
from proofset.llm.jaccard import Rule, keep_one
from proofset.llm.language_id import fit, keep_identified
from proofset.llm.packing import pack
from proofset.llm.secrets import redact_live


LEAST_SCORE = 0.5  # of a document's pooled probability, for its best language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter in it, or no language to which the network gives at least
    half of the probability over all positions. The network is fitted on all labelled texts of this input; without
    any there is none, and all texts with a letter stay."""
    return keep_identified(docs, fit(docs, F.lit(True)), LEAST_SCORE)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of 0.8 or more)."""
    return keep_one(docs, Rule(width=5, num=4, den=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark goes."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are masked; widely copied examples stay."""
    return redact_live(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, as pieces with their ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=True)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("secret_scans", secret_scans), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stored on its way, and what its predecessor left, is deleted once the stage
    is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            remove(spark, before)
        before = path
    return docs
