"""Mixing sources to target weights by systematic sampling.

A source's rate is its target over its size in words. Its documents are put in order of size class, their
expected copies (the rate each) are prefix-summed, one random offset is added per source, and a
document is emitted once per integer boundary crossed. The order by size stratifies the sample. The offset is drawn
OFFSETS times, as hashes of source, seed and number, and the draw whose words come nearest the target is taken, at
every size of source. Documents of size classes over SHARE of the source's target are a stratum of their own: what a draw takes of
them is known first, and the others' rate in that draw makes up the rest of the target. So a source of few documents comes near its
target too, as far as whole documents can, and reruns agree.

Places in the order come from a range partitioning and small per-partition counts, so a source with a third of all
rows is spread over many tasks, and no task sees all sources, which may be very many.

Targets: weights repeat over the sources by code point, null last; no target exceeds `most` times its
source's size, and the excess is shared again by weight among the others. Null text: size 0. A source
of size 0 has target 0 and takes nothing. Repeated rows count each; equal rows may differ in copies. An empty table
gives none; extra columns are ignored by `mix` and carried by `emit`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .common import Scratch, text_steps

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3.0, 7
#: Draws of a source's offset, and size classes to a doubling of the size.
OFFSETS, CLASSES = 32, 4
#: A document of a size class over that of this share of its source's target is large.
SHARE = 0.05
SIZED = "doc_id long, source string, textkey long, size long"


def sizes(batches):
    for rb in batches:
        out = [w.counts(data, off) for _, _, data, off in text_steps(rb)]
        yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())], ["doc_id", "source", "textkey", "size"])


def weighted(counts: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, part, words) of a range partitioning by source, null last, to (source, source_size, weight): weights repeat over the sources in that order."""
    by = counts.groupBy("source").agg(F.min("part").alias("part"), F.sum("words").alias("source_size"))
    # Sources that begin in earlier partitions: one row a partition.
    new = by.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("n"))
    new = new.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    by = by.withColumn("here", here).join(F.broadcast(new), F.col("part") == F.col("p"))
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("earlier") + F.col("here")) % len(weights) + 1).cast("int"))
    return by.select("source", "source_size", pick.alias("weight"))


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """(source, source_size, weight), a written table, to these with `target`.

    Sources whose share of what is left, by weight, exceeds `most` times their size are full; the rest is shared again among the
    others until no further one is. The share of a unit of weight only grows, so this ends; each round is one sum over the sources.
    """
    size, weight, full = F.col("source_size"), F.col("weight"), F.lit(most) * F.col("source_size")
    total, units, level, n = *sources.agg(F.sum(size), F.sum(weight)).first(), None, -1
    if total:
        level = total / units
        while True:
            over = full < F.lit(level) * weight
            used, taken, now = sources.agg(F.sum(F.when(over, size)), F.sum(F.when(over, weight)), F.count(F.when(over, 1))).first()
            if now in (n, 0) or units <= taken:
                break
            n, level = now, (total - most * used) / (units - taken)
    share = F.lit(level).cast("double") * weight
    return sources.select("*", F.least(full, F.coalesce(share, full)).cast("double").alias("target"))


def size_class(size: Column) -> Column:
    return F.floor(CLASSES * F.log2(size + F.lit(1.0)))


def copies_at(rate: Column, offset: Column, most: float) -> Column:
    """Integer boundaries that row i crosses at a rate and an offset."""
    n = F.floor((F.col("i") + 1) * rate + offset) - F.floor(F.col("i") * rate + offset)
    return F.least(n.cast("long"), F.lit(int(np.ceil(most))).cast("long"))


def offset(source: str, seed: int, draw: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(source), F.lit(seed), draw.cast("int")), F.lit(1 << 32)) / F.lit(float(1 << 32))


def take(spark: SparkSession, base: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """base (doc_id, source, textkey, text) to doc_id, source, textkey, size, source_size, target, copies, taken."""
    scratch = Scratch(spark, "mixing")
    sized = scratch.table(base.mapInArrow(sizes, SIZED), "sizes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hash, doc_id and textkey break ties, so equal sizes of one source need not meet in one task.
    order = [F.col("source").isNull(), F.col("source"), size_class(F.col("size")), F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("textkey")]
    ordered = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = scratch.table(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "ordered")
    counts = ordered.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.table(counts.select("source", "part", "first", "words", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "counts")
    sources = scratch.table(weighted(counts, weights), "sources")
    goal = targets(sources, most).withColumnRenamed("source", "g")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    place = counts.join(goal, F.col("source").eqNullSafe(F.col("g"))).select(F.col("source").alias("s"), F.col("part").alias("p"), "first", "before", "source_size", "target", rate.alias("rate"))

    def met(place: DataFrame) -> DataFrame:
        out = ordered.join(place, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        return out.withColumn("i", F.col("row") - F.col("first") + F.col("before"))

    large, draws = size_class(F.col("size")) > size_class(F.col("target") * SHARE), F.sequence(F.lit(0), F.lit(OFFSETS - 1))

    def drawn(rows: DataFrame, rate: Column) -> DataFrame:
        rows = rows.withColumn("draw", F.explode(draws))
        return rows.withColumn("words", copies_at(rate, offset("s", seed, F.col("draw")), most) * F.col("size"))

    # What each draw takes of large documents, and the rate at which the others make up the rest.
    bulk = drawn(met(place).where(large), F.col("rate")).groupBy("s", "draw").agg(F.sum("words").alias("words"), F.sum("size").alias("bulk"))
    bulk = bulk.groupBy(F.col("s").alias("b")).agg(F.first("bulk").alias("bulk"), F.map_from_entries(F.collect_list(F.struct("draw", "words"))).alias("bulk_words"))
    bulk = scratch.table(bulk, "large")
    left, rest = F.col("target") - F.element_at("bulk_words", F.col("draw")), F.col("source_size") - F.col("bulk")
    makes_up = F.when(rest > 0, F.least(F.lit(most), F.greatest(F.lit(0.0), left / rest)))
    rate = F.when(large, F.col("rate")).otherwise(F.coalesce(makes_up, F.col("rate")))
    place = place.join(bulk, F.col("s").eqNullSafe(F.col("b")), "left").drop("b")
    sums = drawn(met(place), rate).groupBy("s", "draw").agg(F.abs(F.sum("words") - F.first("target")).alias("miss"))
    best = scratch.table(sums.groupBy(F.col("s").alias("b")).agg(F.min(F.struct("miss", "draw"))["draw"].alias("draw")), "draws")
    place = place.join(best, F.col("s").eqNullSafe(F.col("b"))).drop("b")
    copies = copies_at(rate, offset("s", seed, F.col("draw")), most)
    return met(place).select("doc_id", "source", "textkey", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, textkey (hash of the text), size, source_size, target, copies, taken: one row per document."""
    text = F.col("text").cast("string")
    return take(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("textkey"), text.alias("text")), weights, most, seed)


def emit(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; rows that are equal in all columns (maps apart) as often as all of them together."""
    doc_id, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    whole = F.xxhash64(*[docs[f.name] for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    mixed = take(spark, docs.select(doc_id.alias("doc_id"), source.alias("source"), whole.alias("textkey"), text.alias("text")), weights, most, seed).where("copies > 0")
    one = lambda i, s: [F.coalesce(i, F.lit(-(1 << 63))).alias("k1"), F.coalesce(s, F.lit("\0")).alias("k2")]
    plan = mixed.groupBy(*one(F.col("doc_id"), F.col("source")), F.col("textkey").alias("k3")).agg(F.sum("copies").cast("int").alias("copies"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *one(doc_id, source), whole.alias("k3")).join(plan, ["k1", "k2", "k3"]).dropDuplicates(["k1", "k2", "k3"])
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])
