"""Similarity classes without all pairs: LSH buckets, star rounds, an exact rest, connected components.

Nodes come with a sketch and bucket keys. In a bucket every node is first compared with one hub
only, the node that meets most others; nodes that a link joins need no further comparison with each
other. Rounds with other hubs go on while they lower what is left; then the rest is compared exactly: every pair of a bucket whose members are still in
different components, taken from the smaller sides against all. So no link between components is
lost, and a large group of copies costs comparisons in proportion to its size.

Everything stays in DataFrames; each round's links and labels are written tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, grown_components
from ..scratch import Scratch

#: Rounds at most, and comparisons a bucket row at which the exact rest begins.
ROUNDS, LIGHT = 8, 4
#: Members of a bucket up to which the rest is compared as joined pairs, and members of a block beyond.
SMALL, BLOCK = 64, 256
#: 64-bit words of a sketch, 16 coordinates of four bits each.
SKETCH_WORDS = 16


def agreeing(x: str, y: str, words: int = SKETCH_WORDS) -> Column:
    """In how many of their four-bit coordinates two sketches of 64-bit words agree."""
    z = [F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))) for i in range(words)]
    fold = [v.bitwiseOR(F.shiftright(v, 1)) for v in z]
    fold = [v.bitwiseOR(F.shiftright(v, 2)).bitwiseAND(F.lit(0x1111111111111111)) for v in fold]
    return F.lit(16 * words) - reduce(lambda a, b: a + b, [F.bit_count(v) for v in fold])


def accepted(accept: Callable[[bytes, bytes], bool]) -> Callable:
    """Rows of (payload, payload, *others) whose payloads make a link: the others."""

    def run(batches):
        for rb in batches:
            ok = [accept(x, y) for x, y in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True)]
            yield rb.select(rb.schema.names[2:]).filter(pa.array(ok, pa.bool_()))

    return run


def block_links(accept: Callable[[bytes, bytes], bool], ratio: int, agree: int) -> Callable:
    """Labels of members of two blocks of a bucket that link though they are in different components.

    A pair that meets in several buckets is compared in that of its first common key only.
    """

    def members(x) -> tuple:
        col = lambda k, t: np.array([m[k] for m in x], t)
        return col("id", np.int64), col("label", np.int64), col("size", np.int64), col("sketch", np.int64).view(np.uint64), col("keys", np.int64), [m["payload"] for m in x]

    def run(batches):
        for rb in batches:
            found = []
            for r in rb.to_pylist():
                ia, la, sa, ka, ca, pa_ = members(r["one"])
                ib, lb, sb, kb, cb, pb = members(r["two"])
                for n in range(len(ia)):
                    ok = (lb != la[n]) & (100 * np.minimum(sb, sa[n]) >= ratio * np.maximum(sb, sa[n]))
                    if r["i"] == r["j"]:
                        ok &= ib > ia[n]
                    at = np.flatnonzero(ok)
                    z = ka[n] ^ kb[at]
                    z |= z >> np.uint64(1)
                    z = (z | z >> np.uint64(2)) & np.uint64(0x1111111111111111)
                    at = at[16 * z.shape[1] - np.bitwise_count(z).sum(1, dtype=np.int64) >= agree]
                    same = ca[n] == cb[at]
                    at = at[ca[n][same.argmax(1)] == r["key"]] if len(at) else at
                    found += [(int(la[n]), int(lb[m])) for m in at.tolist() if accept(pa_[n], pb[m])]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def by_blocks(rows: DataFrame, payload: DataFrame, accept: Callable[[bytes, bytes], bool], ratio: int, agree: int) -> DataFrame:
    """Links, as pairs of labels, of large buckets (key, id, size, sketch, keys, n, label, major): blocks of about BLOCK members meet two by two."""
    full = rows.join(payload, "id").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("i", F.pmod(F.xxhash64("id"), "blocks"))
    member = F.struct("id", "label", "size", "sketch", "keys", "payload")
    blocks = full.groupBy("key", "i", "blocks").agg(F.collect_list(member).alias("members"), F.bool_and(F.col("label") == F.col("major")).alias("plain"))
    one = blocks.select("key", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"), F.col("members").alias("one"), F.col("plain").alias("p"))
    two = blocks.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i"))).alias("i"), F.col("i").alias("j"), F.col("members").alias("two"), F.col("plain").alias("q"))
    met = one.join(two, ["key", "i", "j"]).where("not (p and q)").select("key", "i", "j", "one", "two")
    return met.mapInArrow(block_links(accept, ratio, agree), "a long, b long")


def link_classes(nodes: DataFrame, payloads: Callable[[DataFrame], DataFrame], accept: Callable[[bytes, bytes], bool], ratio: int, agree: int, scratch: Scratch) -> DataFrame:
    """(node, label) for every node that has a link.

    nodes: id long (unique), size long, sketch array<long>, keys array<long>. payloads(ids) gives
    (id, payload binary) of the ids asked for; accept(payload, payload) confirms a link on them.
    Links need 100 * smaller size >= ratio * larger size. agree: equal sketch coordinates
    under which a pair reaches the threshold only with negligible probability.
    """
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.table(keyed.join(shared, "key"), "met")
    rows = scratch.table(met.join(nodes, "id"), "buckets")
    # The node that meets most others is nearest to the middle of its group, as the source of copies is.
    central = rows.groupBy("id").agg(F.sum("n").alias("met"))
    top = rows.select("key", "id").join(central, "id").groupBy("key").agg(F.max_by("id", "met").alias("hub"))
    payload = scratch.table(payloads(rows.select("id").distinct()), "payloads")

    def near(table: DataFrame, other: DataFrame, more: str = "true") -> DataFrame:
        """Pairs (a, b) of a bucket that fit in size and whose sketches agree enough, with the labels (la, lb) of either."""
        fits = F.expr(f"100 * least(size, sx) >= {ratio} * greatest(size, sx) and id <> x and {more}")
        met = table.join(other.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & fits & (agreeing("sketch", "kx") >= agree))
        return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"), F.least("label", "lx").alias("la"), F.greatest("label", "lx").alias("lb")).distinct()

    def as_other(table: DataFrame, *more: str) -> DataFrame:
        return table.select("key", F.col("id").alias("x"), F.col("size").alias("sx"), F.col("sketch").alias("kx"), F.col("label").alias("lx"), *more)

    def of_hubs(table: DataFrame, hubs: DataFrame) -> DataFrame:
        return as_other(table.join(hubs.withColumnsRenamed({"key": "k", "hub": "h"}), (F.col("key") == F.col("k")) & (F.col("id") == F.col("h"))))

    def confirm(pairs: DataFrame) -> DataFrame:
        """Links as pairs of labels, the edges by which components grow."""
        p = pairs.join(payload.select(F.col("id").alias("b"), F.col("payload").alias("pb")), "b").join(payload.select(F.col("id").alias("a"), F.col("payload").alias("pa")), "a")
        links = p.select("pa", "pb", F.col("la").alias("a"), F.col("lb").alias("b")).mapInArrow(accepted(accept), "a long, b long")
        return scratch.table(links, "links")

    alone = rows.withColumn("label", F.col("id"))
    pairs = scratch.table(near(alone, of_hubs(alone, top)), "pairs")
    tested = pairs.select("a", "b")
    labels = connected_components(confirm(pairs), scratch.table)
    before = None
    for r in range(ROUNDS):
        marked = rows.drop("n").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        sides = marked.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", "n").alias("major"))
        marked = scratch.table(marked.join(sides.where("most < n").drop("most"), "key"), "open")
        # What an exact comparison of all that is left would take.
        work, left = marked.agg(F.sum(F.when(F.col("label") != F.col("major"), F.col("n"))), F.count("*")).first()
        if not work:
            return labels
        last = r == ROUNDS - 1 or work <= LIGHT * left or before is not None and work > 0.9 * before
        before = work
        if last:
            # In a large bucket pairs are compared block by block and only links leave the task.
            small = marked.where(F.col("n") <= SMALL)
            few = as_other(small.where("label <> major"), F.col("keys").alias("keysx"))
            pairs = near(small, few, "lx <> label and (label = major or x < id) and get(array_intersect(keys, keysx), 0) = key")
            blocks = scratch.table(by_blocks(marked.where(F.col("n") > SMALL), payload, accept, ratio, agree), "links")
        else:
            hubs = marked.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key", F.lit(r))).alias("hub"))
            pairs = near(marked, of_hubs(marked, hubs), "lx <> label")
        pairs = scratch.table(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs.select("a", "b"))
        found = confirm(pairs)
        labels = grown_components(labels, found.unionByName(blocks) if last else found, scratch.table)
        if last:
            break
    return labels
