"""Frame sequences from tables: (video_id, frame_idx, timestamp, phash, h)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H

COLUMNS = ["video_id", "frame_idx", "timestamp", "phash", "h"]


def shape(df: DataFrame, fps: float = 1.0) -> DataFrame:
    """From video_id, frame_idx, h."""
    return df.select("video_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), (F.col("frame_idx") / F.lit(float(fps))).alias("timestamp"), H.to_hex("h").alias("phash"), "h")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where its files make fewer tasks than there are; a large table stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def doc_frames(documents: DataFrame, fps: float = 1.0, words: int = H.FRAME_WORDS) -> DataFrame:
    """Each run of `words` words is a frame; its code is the SimHash of the words' MD5 prefixes. Rows of one id add up.

    Where no id repeats, a document's frames come from its own row and nothing is shuffled.
    """
    rows = spread(documents.select("doc_id", "text"), "doc_id")
    if documents.groupBy("doc_id").count().where("count > 1").isEmpty():
        kind = documents.schema["doc_id"].dataType.simpleString()
        text = rows.where("text is not null").select(F.col("doc_id").alias("video_id"), F.lower("text").alias("text"))
        return shape(text.mapInArrow(H.simhash_rows(words), f"video_id {kind}, frame_idx long, h long"), fps)
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = rows.select(F.col("doc_id").alias("video_id"), F.posexplode(w).alias("pos", "word"))
    rows = rows.select("video_id", F.floor(F.col("pos") / words).alias("frame_idx"), H.word_code(F.col("word")).alias("u"))
    sums = rows.groupBy("video_id", "frame_idx").agg(*H.simhash_sums(F.col("u")))
    return shape(sums.select("video_id", "frame_idx", H.simhash_of_sums().alias("h")), fps)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """frame_idx from 0 within video_id."""
    return df.withColumn("frame_idx", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)) - 1)


def emb_frames(embeddings: DataFrame, fps: float = 1.0) -> DataFrame:
    """Vectors of a label in id order are its frames; the code is the signs of the components."""
    rows = embeddings.select(F.col("label").cast("bigint").alias("video_id"), "vec_id", H.sign_hash(F.col("embedding")).alias("h"))
    return shape(numbered(rows, "vec_id"), fps)


def line_frames(documents: DataFrame, fps: float = 1.0) -> DataFrame:
    """Lines are frames; equal lines alone agree."""
    rows = documents.where("text is not null").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("frame_idx", "line"))
    return shape(rows.select("video_id", "frame_idx", H.from_hex(F.substring(F.md5(F.col("line").cast("binary")), 1, 16)).alias("h")), fps)


def event_frames(events: DataFrame, fps: float = 1.0) -> DataFrame:
    """A user's events in time order: few distinct codes, for skew."""
    rows = events.select(F.col("user_id").alias("video_id"), "ts", "event_id", H.from_hex(F.substring(F.md5(F.col("event_type").cast("binary")), 1, 16)).alias("h"))
    return shape(numbered(rows, "ts", "event_id"), fps)


def videos_of(frames: DataFrame, fps: float = 1.0) -> DataFrame:
    """(id, duration, n_frames) of frame sequences that have no files."""
    return frames.groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("n_frames")).select("id", (F.col("n_frames") / F.lit(float(fps))).alias("duration"), "n_frames")
