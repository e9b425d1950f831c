"""Index against file system: what cleanup, sync and continue decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, extension, group_number, stem

DEPENDENTS = {"frame_hashes": ("video_id",), "audio_fingerprints": ("video_id",), "matches": ("video_a_id", "video_b_id"), "comparisons": ("video_a_id", "video_b_id"), "candidate_pairs": ("video_a_id", "video_b_id"), "videos": ("id",)}


def presence(videos: DataFrame, listing: DataFrame, column: str) -> DataFrame:
    """videos with `present`: whether the path in `column` is listed."""
    there = listing.select(F.col("path").alias(column), F.lit(True).alias("present")).distinct()
    return videos.join(there, column, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def group_outcomes(videos: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """group_id, n_records, n_deleted, returned_id: one row per group directory with records.

    Deleted members' records go; a single survivor of a group that lost members is returned."""
    m = presence(videos.where("moved_to is not null"), listing, "moved_to").withColumn("group_id", group_number("moved_to", root)).where("group_id is not null")
    g = m.groupBy("group_id").agg(F.count("*").alias("n_records"), F.sum((~F.col("present")).cast("long")).alias("n_deleted"), F.min(F.when(F.col("present"), F.col("id"))).alias("one"))
    alone = (F.col("n_deleted") > 0) & (F.col("n_records") - F.col("n_deleted") == 1)
    return g.select("group_id", "n_records", "n_deleted", F.when(alone, F.col("one")).alias("returned_id"))


def deleted_members(videos: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    m = presence(videos.where("moved_to is not null"), listing, "moved_to")
    return m.where(~F.col("present") & group_number("moved_to", root).isNotNull()).select("id")


def return_plan(videos: DataFrame, outcomes: DataFrame, listing: DataFrame) -> DataFrame:
    """id, source, target of returned survivors; a taken place gets stem_returned.ext."""
    v = videos.join(outcomes.where("returned_id is not null").select(F.col("returned_id").alias("id")), "id").select("id", F.col("moved_to").alias("source"), "path")
    v = presence(v, listing, "path")
    folder = F.when(dirname("path") == "", F.lit("")).otherwise(F.concat(dirname("path"), F.lit("/")))
    other = F.concat(folder, stem("path"), F.lit("_returned"), extension("path"))
    return v.select("id", "source", F.when(F.col("present"), other).otherwise(F.col("path")).alias("target"))


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the videos in ids (id), candidate pairs included."""
    out = {}
    for name, df in tables.items():
        for key in DEPENDENTS.get(name, ()):
            df = df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(*df.columns)
        out[name] = df
    return out


def missing(videos: DataFrame, listing: DataFrame) -> DataFrame:
    """Videos that are neither at path nor at moved_to."""
    there = listing.select("path").distinct()
    gone = videos.join(there, "path", "left_anti")
    return gone.join(there.withColumnRenamed("path", "moved_to"), "moved_to", "left_anti").select(*videos.columns)


def is_stale(videos: DataFrame, last_run: str) -> DataFrame:
    """One row, stale: whether a video was processed after last_run (ISO, UTC). Empty or unparsable: false."""
    t = F.try_to_timestamp(F.regexp_replace(F.lit(last_run), "Z$", "+00:00"))
    return videos.agg(F.max("fingerprinted_at").alias("newest")).select(F.coalesce(F.col("newest") > F.unix_micros(t) / 1e6, F.lit(False)).alias("stale"))


__all__ = ["basename", "cascade_delete", "deleted_members", "group_outcomes", "is_stale", "missing", "presence", "return_plan"]
