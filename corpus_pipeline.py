"""The corpus pipeline: five stages over ``documents``, each on all rows that the
stage before it kept, written as Parquet in the shared folder in between.

1. toxicity: documents scored 0.5 or more go.
2. jaccard_join: one document of each group of near copies stays (five-word
   shingles, similarity 0.8 or more).
3. suffix_dedup: bytes covered by 200-byte strings that start twice or more are
   cut from the texts; documents without a word left go.
4. decontamination: documents that hold 0.8 or more of a benchmark item's
   five-word shingles go.
5. mixing: how many words of each document the mix takes, by source weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungfleet.llm import containment, jaccard_join, mixing, repeats, toxicity
from rungfleet.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return containment.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The toxicity stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
