"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns
it was given; the last adds the shard columns.  Between stages the rows are
written to the shared folder, so a lost executor costs no earlier stage.

* quality: documents that the quality rules reject go.
* near_duplicates: of each group of near duplicates the one with the smallest
  id stays.
* decontaminate: documents that hold an eight-word window of any benchmark item go.
* mix: sources meet their target weights; a document appears as often as its copies.
* shard: adds size, law, shard and slot.

Column names of the input may be anything: the operators see numbered names.
Null texts go in the first stage (they have no words); rows without an id are
never taken for duplicates; empty tables pass through empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.llm import decontaminate, mixing, near_duplicates, quality, sharding
from trellisq.llm.shared import documents, released, small_batches, stored

NAMES = ("doc_id", "text", "lang", "source")


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs with columns c0, c1, ...; what the operators' columns are called there; and the way back."""
    small_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    return plain, {x: f"c{names.index(x)}" for x in NAMES}, lambda df: df.select(*(F.col(f"c{k}").alias(x) for k, x in enumerate(names)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at, back = _numbered(docs)
    labels = documents(spark, sf_dir, "labels").select(F.col("doc_id").alias(at["doc_id"]), "quality")
    return back(quality.judge(plain, labels, at["text"], at["lang"], at["doc_id"]).where("kept"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at, back = _numbered(docs)
    return back(near_duplicates.deduplicated(plain, at["text"], at["doc_id"]))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at, back = _numbered(docs)
    return back(decontaminate.annotate(plain, documents(spark, sf_dir, "benchmark"), at["text"], min_items=1).where("not contaminated"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at, back = _numbered(docs)
    taken = mixing.mixed(plain, at["text"], at["source"], at["doc_id"]).where("copies > 0")
    return back(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at, _ = _numbered(docs.drop("size", "law", "shard", "slot"))
    names = [x for x in docs.columns if x not in ("size", "law", "shard", "slot")]
    out = sharding.sharded(plain, text=at["text"], id_=at["doc_id"])
    return out.select(*(F.col(f"c{k}").alias(x) for k, x in enumerate(names)), "size", "law", "shard", "slot")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: The rows depend on learned cutoffs, sketches and tilts, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        released(spark, keep=docs)  # scratch tables of the stage, and its input
    return docs
