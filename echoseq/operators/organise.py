"""From matches to groups, numbers and a plan of moves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, extension, group_number, stem
from .graph import connected_components
from .tables import in_order


def groups(matches: DataFrame, table: Callable) -> DataFrame:
    """(video_id, label) of the components of matches that are not moved."""
    edges = matches.where("moved = 0").select(F.col("video_a_id").alias("a"), F.col("video_b_id").alias("b"))
    return connected_components(edges, table).select(F.col("node").alias("video_id"), "label")


def numbered(members: DataFrame, matches: DataFrame, base: int = 0) -> DataFrame:
    """(video_id, group_id): groups numbered from base + 1 in the order of their first match."""
    first = matches.where("moved = 0").select("id", F.col("video_a_id").alias("video_id")).join(members, "video_id").groupBy("label").agg(F.min("id").alias("first"))
    number = in_order(first, [F.col("first")]).select("label", (F.col("before") + base + 1).cast("long").alias("group_id"))
    return members.join(number, "label").select("video_id", "group_id")


def next_base(videos: DataFrame, root: str) -> int:
    """The highest group number that a moved video's path holds; 0 without one."""
    return videos.agg(F.max(group_number("moved_to", root))).first()[0] or 0


def move_plan(members: DataFrame, videos: DataFrame, root: str, listing: DataFrame | None = None) -> DataFrame:
    """video_id, group_id, source, target. A file's present place is moved_to if set, else path. With a
    listing (path), missing files have no row and names taken on disk collide too. A name that another
    member has (first by id) or that is taken gets the id: stem_id.ext."""
    v = videos.select(F.col("id").alias("video_id"), F.coalesce("moved_to", "path").alias("source"))
    p = members.join(v, "video_id")
    if listing is not None:
        p = p.join(listing.select(F.col("path").alias("source")).distinct(), "source", "left_semi")
    name = basename("source")
    again = F.row_number().over(Window.partitionBy("group_id", name).orderBy("video_id")) > 1
    folder = F.concat(F.lit(root + "/"), F.col("group_id").cast("string"), F.lit("/"))
    p = p.withColumn("plain", F.concat(folder, name)).withColumn("again", again)
    if listing is not None:
        p = p.join(listing.select(F.col("path").alias("plain"), F.lit(True).alias("taken")).distinct(), "plain", "left").withColumn("again", F.col("again") | F.coalesce("taken", F.lit(False)))
    other = F.concat(folder, stem("source"), F.lit("_"), F.col("video_id").cast("string"), extension("source"))
    return p.select("video_id", "group_id", "source", F.when(F.col("again"), other).otherwise(F.col("plain")).alias("target"))


def summary(members: DataFrame) -> DataFrame:
    """n_videos, n_groups of a dry run."""
    return members.agg(F.count("*").alias("n_videos"), F.countDistinct("label").alias("n_groups"))
