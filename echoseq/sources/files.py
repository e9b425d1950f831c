"""Directory listings as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_video
from .store import FOLDER

GROUPS = "duplicates"


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """(path) of all files under a directory, the index folder left out. Contents aren't read."""
    if not any(os.scandir(directory)):
        return spark.createDataFrame([], "path string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{directory}").select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    return files.where(~F.col("path").contains(f"/{FOLDER}/"))


def find_videos(spark: SparkSession, directory: str, with_groups: bool = False) -> DataFrame:
    """(path) of video files. Files that a move has put into the groups folder are no new videos unless asked for."""
    out = listing(spark, directory).where(is_video("path"))
    return out if with_groups else out.where(~F.startswith("path", F.lit(f"{directory}/{GROUPS}/")))
