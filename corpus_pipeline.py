"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, then the training mix.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps of ``docs`` with their columns;
the last returns them with their place in the mix. Stages work on all rows they get and handle nulls,
empty and very long texts, repeated rows, empty tables and extra columns as their operators say:

* toxicity: null and empty texts stay; a text scoring 0.7 or more goes.
* exact_dedup: of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays.
* near_dedup: of each component of 0.8 Jaccard links over five-word shingles the row with the
  smallest doc_id stays; texts without words link with nothing and stay.
* decontamination: a text that holds a benchmark item goes.
* mixing: all rows stay; ``taken`` says how many words of each the mix takes, ``position`` when.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.decontamination import drop_contaminated
from gristmill.llm.exact_dedup import drop_copies
from gristmill.llm.mixing import curriculum_mix
from gristmill.llm.ngram_join import drop_near_copies
from gristmill.llm.queries import read, toxicity_model
from gristmill.llm.toxicity import drop_toxic
from gristmill.llm.workspace import Workspace

#: The decisions rest on a trained model, linked components and windows, which SQL doesn't express.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, toxicity_model(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum_mix(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    work, docs = Workspace(spark), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.table(docs, name)
            if k:
                work.drop(STAGES[k - 1][0])
    return docs
