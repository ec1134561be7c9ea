"""Documents to packed training sequences, in five stages.

Each stage takes the rows its predecessor kept; all but the last return the
columns of documents. Stages that drop rows compare whole rows' hashes, so rows
with null or repeated ids are handled like any other.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import exact, packing, toxic
from caseloom.llm.jaccard import drop_near_copies
from caseloom.llm.queries import RANKS
from caseloom.llm.suffix import without_repeats
from caseloom.llm.tables import lean, stored

HELD_OUT = (3, 1)
SAMPLE = 1500
#: bytes that any passage of more than 50 words has: 51 words of one letter, and the spaces between
PASSAGE = 101


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, trained on the labelled documents: rows scored 0.7 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxic.train(docs, labels, HELD_OUT, SAMPLE)
    names, schema = docs.columns, docs.schema
    where = names.index("text")

    def run(batches):
        for batch in batches:
            if net is None:
                yield batch
            else:
                score = toxic.score_texts(batch.column(where), net)
                yield batch.filter(pa.array(score < toxic.THRESHOLD))

    return docs.mapInArrow(lean(run), schema)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the largest doc_id stays."""
    return exact.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each linked group the smallest doc_id stays."""
    return drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, for strings of ``PASSAGE`` bytes: those that start elsewhere too go."""
    return without_repeats(docs, length=PASSAGE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row per piece of a sequence."""
    return packing.pack_documents(docs, RANKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: SQL can express neither the network nor the greedy packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
