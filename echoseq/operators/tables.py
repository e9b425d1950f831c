"""Changes of tables as table-in, table-out functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new; repeats within rows count once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of the same key."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(rows)


def update(table: DataFrame, ids: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """Rows whose key is in ids (id) get the changes."""
    hit = ids.select(F.col("id").alias(key), F.lit(True).alias("_hit")).distinct()
    t = table.join(hit, key, "left")
    return t.select(*[F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


def flag_pairs(matches: DataFrame, ids: DataFrame, value: int, both: bool = True) -> DataFrame:
    """matches.moved = value where both ends (or either end) are in ids (id)."""
    mark = lambda k, name: ids.select(F.col("id").alias(k), F.lit(True).alias(name)).distinct()
    t = matches.join(mark("video_a_id", "_a"), "video_a_id", "left").join(mark("video_b_id", "_b"), "video_b_id", "left")
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    hit = a & b if both else a | b
    return t.select(*[F.when(hit, F.lit(value)).otherwise(F.col(c)).alias(c) if c == "moved" else F.col(c) for c in matches.columns])


def in_order(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """df with `before`: the number of rows before each in the given order, and for each column of `sums` what those rows add up
    to, as <column>_before. Rows are range-partitioned and only one row a partition is brought together, so no task sees all.
    Rows that the order doesn't tell apart may be in one task; the order should have no large ties."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = Scratch(spark, "order").table(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "placed")
    # One row a partition.
    per = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"), *[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_part", "_first", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in ("n", *sums)])
    out = placed.join(F.broadcast(per), "_part")
    here = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    more = [(F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(f"{c}_before") for c in sums]
    return out.select(*df.columns, (F.col("_b_n") + F.col("_row") - F.col("_first")).alias("before"), *more)


def register(videos: DataFrame, paths: DataFrame) -> DataFrame:
    """New paths as unprocessed videos; ids go on from the highest in path order."""
    top = videos.agg(F.max("id")).first()[0] or 0
    new = in_order(paths.select("path").distinct().join(videos.select("path"), "path", "left_anti"), [F.col("path")])
    null = lambda t: F.lit(None).cast(t)
    return new.select((F.col("before") + top + 1).cast("long").alias("id"), "path", null("double").alias("duration"), null("double").alias("fingerprinted_at"), null("string").alias("moved_to"))


def unprocessed(videos: DataFrame) -> DataFrame:
    return videos.where("fingerprinted_at is null").select("id", "path")
