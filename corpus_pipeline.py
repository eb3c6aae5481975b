"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

quality rules -> toxicity -> near duplicates -> mixing to target weights -> best-fit packing. Every stage but the last
returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewright.llm import mixing, neardup, packing, quality, toxicity
from framewright.llm.common import Workspace

TOKENIZER = "byte_bpe_50k.json"
# The share of tokens that each domain is to have. Near those of the corpus, so that few documents repeat.
TARGETS = {"de": 0.165, "en": 0.55, "es": 0.12, "fr": 0.165}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose learnt quality is below the threshold go.

    NULL, empty and wordless texts fail the rules and go; texts of any length are judged whole; NULLs elsewhere don't
    matter; repeated rows go or stay together; an empty table gives an empty one; columns of any name pass through.
    """
    return quality.keep(docs, quality.model_for(docs, _labels(spark, sf_dir)))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic, from a score of 0.5 on, go.

    NULL, empty and wordless texts aren't toxic and stay; texts of any length are scored whole; NULLs elsewhere don't
    matter; repeated rows go or stay together; an empty table gives an empty one; columns of any name pass through.
    """
    return toxicity.keep(docs, toxicity.model_for(docs, _labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id: five-word shingles, 80 percent of the union in common.

    NULL, empty and wordless texts and rows without doc_id are in no group and stay; texts of any length are compared
    whole; of rows that repeat doc_id and text one stays; an empty table gives an empty one; columns of any name pass
    through.
    """
    return neardup.keep(docs, 5, 80)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains that have too few tokens repeat, by rates fitted to the targets.

    No document goes. NULL and empty texts have no tokens and repeat by the prior posteriors; texts of any length are
    read whole; NULLs elsewhere don't matter; repeated rows repeat alike; an empty table gives an empty one; columns of
    any name pass through.
    """
    return mixing.mixed(docs, _labels(spark, sf_dir), TARGETS, public_tokenizers.path(TOKENIZER))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens.

    NULL and empty texts are one closing token; texts of any length are cut into whole pieces; pieces of equal length
    go by doc_id and piece; repeated rows, as the mix makes them, are packed each; an empty table gives an empty
    result; other columns aren't read.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near duplicates", near_duplicates),
    ("target mix", target_mix),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir))
        work.keep_only(docs)
    return docs
