"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings of video files.
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm")


def basename(c: Column | str) -> Column:
    return F.substring_index(c, "/", -1)


def dirname(c: Column | str) -> Column:
    return F.regexp_replace(c, r"/?[^/]*$", "")


def extension(c: Column | str) -> Column:
    """The ending with its dot; a name's leading dots start no ending."""
    return F.regexp_extract(basename(c), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(c: Column | str) -> Column:
    name = basename(c)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(c)))


def is_video(c: Column | str) -> Column:
    return F.lower(extension(c)).isin(*VIDEO_EXTENSIONS)


def group_number(c: Column | str, root: str) -> Column:
    """N of a path <root>/N/..., null for other paths."""
    got = F.when(F.startswith(c, F.lit(root + "/")), F.split_part(F.substring(c, F.lit(len(root) + 2), F.length(c)), F.lit("/"), F.lit(1)))
    return F.when(got.rlike(r"^[0-9]+$"), got.cast("long"))
