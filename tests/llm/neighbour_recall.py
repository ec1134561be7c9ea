"""Share of the whole table's 24 nearest BM25 neighbours that lie in a seed's shard: python tests/llm/neighbour_recall.py SF_DIR [SEEDS]."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from caseloom.llm import packing
from caseloom.llm.queries import RANKS


def main(sf_dir: str, seeds: int) -> None:
    spark = SparkSession.builder.master("local[6]").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").getOrCreate()
    rows = packing.tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"), RANKS, 0, "<u2", "doc_id", "text").withColumn("tie", F.xxhash64("doc_id", "ids"))
    near = rows.repartitionByRange("k1", "k2", "tie").sortWithinPartitions("k1", "k2", "tie", "doc_id").withColumn("part", F.spark_partition_id())
    held = near.select("part", "ids").toPandas()
    docs = [np.frombuffer(x, "<u2") for x in held.ids]
    shard, number, count, tokens = [], -1, 0, 0
    for k, d in enumerate(docs):
        if k == 0 or held.part[k] != held.part[k - 1] or count == packing.SHARD_DOCS or tokens >= packing.SHARD_TOKENS:
            number, count, tokens = number + 1, 0, 0
        shard.append(number)
        count, tokens = count + 1, tokens + len(d)
    shard = np.array(shard)
    index = packing.Bm25(docs, packing.Corpus.of(docs))
    found = wanted = got = best = 0.0
    for seed in np.random.default_rng(0).choice(len(docs), min(seeds, len(docs)), replace=False).tolist():
        score, other = index.scores(seed), np.arange(len(docs)) != seed
        whole, own = index.neighbours(score, other), index.neighbours(score, other & (shard == shard[seed]))
        found, wanted = found + len(set(whole) & set(own)), wanted + len(whole)
        got, best = got + score[own].sum(), best + score[whole].sum()
    print(f"{len(docs)} documents, {number + 1} shards: recall {found / wanted:.4f}, score of the shard's 24 nearest over the whole table's {got / best:.4f}")


main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 500)
