"""A corpus pipeline over `documents`: each stage's result is written as Parquet and read as the next one's input.

Part of the subpackage llm. All stages but the last return the columns of `documents`, and clean documents stay whole. Null or
empty texts are clean, near-duplicates of nothing, without repeats, of size 0 (so the mix takes a source's share of them as of any
other rows) and one token long. Rows with a null doc_id pass the stages as rows of their own. Extra columns, whatever their names,
are carried to the mix; repeated rows count once after near-duplicates. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoseq.llm import minhash, mixing, packing, substring, toxicity
from echoseq.llm.common import Scratch, read
from echoseq.session import ship

#: Documents link from this percentage of their shingles' union in common on.
SIMILARITY = 80
#: Workers live on from stage to stage, so the tokenizer's cache is kept smaller here than in packing alone.
CACHE_ENTRIES = 200_000


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    ship(spark)
    return toxicity.reject(docs, toxicity.fit(spark, docs, read(spark, sf_dir, "labels")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays; rows that repeat a doc_id and text count once, rows without a doc_id all stay."""
    ship(spark)
    found = minhash.near_duplicates(spark, docs, SIMILARITY)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("k"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    left = rows.join(gone, F.col("k") == F.col("_gone"), "left_anti")
    once = left.where("k is not null").dropDuplicates(["k", "t"]).unionByName(left.where("k is null"))
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside passages that occur more than once go; documents stay."""
    ship(spark)
    return substring.cut_texts(spark, docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    return mixing.emit(spark, docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(spark, docs, cache_entries=CACHE_ENTRIES)


STAGES = [("toxicity", keep_clean), ("near-duplicates", keep_one), ("substrings", cut_repeats), ("mixing", to_weights), ("packing", into_sequences)]
#: No stage but the near-duplicates is within reach of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
