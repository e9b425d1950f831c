"""The persisted search index: the packed blocks of codes by band cell, and one meta row that says what they were built from."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TABLES
from ..operators import hamming_join as J
from ..operators.tables import upsert
from .store import Store

META, BLOCKS = "index_meta", "index_blocks"


def meta(rows: DataFrame) -> DataFrame:
    """The one row of the meta table, or none."""
    return rows.where("id = 1")


def meta_row(store: Store, version: int, threshold: int, codes: int) -> DataFrame:
    return store.spark.createDataFrame([(1, time.time(), version, threshold, codes)], TABLES[META])


def put_meta(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The meta table with its row replaced."""
    return upsert(rows, new, ["id"])


def is_fresh(rows: DataFrame, version: int, threshold: int) -> bool:
    """Whether blocks exist for this version of the frames and this threshold. A count of frames wouldn't tell: it may be the same after a change."""
    return not meta(rows).where((F.col("version") == version) & (F.col("threshold") == threshold)).isEmpty()


def build(store: Store, threshold: int) -> bool:
    """Builds the blocks unless they are fresh; whether it did."""
    version = store.table_version("frame_hashes")
    if is_fresh(store.read(META), version, threshold):
        return False
    codes = store.read("frame_hashes").select("h").distinct()
    n = codes.count()
    blocks = J.placed(codes, J.choose(threshold, n))
    store.commit(replace={BLOCKS: blocks, META: put_meta(store.read(META), meta_row(store, version, threshold, n))})
    return True


def near(store: Store, threshold: int) -> DataFrame:
    """(h1, h2, dist) of all codes from the blocks; LookupError where there are none for this threshold."""
    row = meta(store.read(META)).first()
    if row is None or row["threshold"] != threshold:
        raise LookupError("no search index for this threshold; build it first")
    return J.near_of(store.read("frame_hashes"), threshold, J.choose(threshold, row["codes"]), store.read(BLOCKS))


def invalidate(store: Store) -> None:
    """Drops the blocks and clears the meta table; the next match builds them again."""
    store.drop(BLOCKS, META)
