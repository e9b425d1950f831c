"""Exact substring dedup by seed and extend.

Seeds are runs of 16 words, winnowed: of every 20 consecutive seeds the least hash is kept, so each
window of 35 words keeps a seed at a place that depends on its words alone. Documents meet on kept
seeds that occur twice or more. Around such an anchor the match is extended both ways: every window of
35 words that holds it is hashed (80 bits), and windows met twice are repeats. Runs of repeated
windows are the maximal repeats over the threshold. Extension is done against all partners at once
through counts, so a passage in a third of all documents costs no pairs and no unbounded group.

A null or wordless text has no words: n_removed 0, kept text empty. Repeated rows are other places of
their words, so both lose them. Rows are told apart by doc_id (null allowed) and a hash of the text.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .common import Scratch, documents, text_steps

U64 = np.uint64
WINDOW, SEED = 35, 16


def windowed(x: np.ndarray, size: int, op) -> np.ndarray:
    """op (minimum or maximum) over x[i : i + size] for every i, by doubling."""
    span, out = 1, x
    while span * 2 <= size:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[: len(x) - size + 1], out[size - span : len(x) - span + 1]) if size > span else out


def anchors_of(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word number in the text, seed hash) of every kept seed."""
    n = np.diff(first)
    long = np.flatnonzero(n >= window)
    per = n[long] - seed + 1
    s = w.run_hashes(hashes, w.ranges(first[long], per), seed) | U64(1)
    if not len(s):
        return long, long, s
    span = window - seed + 1
    low = windowed(s, span, np.minimum)
    ends = np.cumsum(per)
    owner = np.repeat(np.arange(len(long)), per)
    inside = np.arange(len(low)) + span <= ends[owner[: len(low)]]
    low = np.where(inside, low, U64(0))
    pad = np.zeros(span - 1, U64)
    best = windowed(np.concatenate([pad, low, pad]), span, np.maximum)
    kept = np.flatnonzero(best == s)
    return long[owner[kept]], kept - (ends - per)[owner[kept]], s[kept]


def anchor_rows(batches):
    for rb in batches:
        for lo, hi, data, off in text_steps(rb):
            starts, ends, first = w.spans(data, off)
            doc, pos, seed = anchors_of(w.word_hashes(data, starts, ends), first)
            take = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays([rb.column(0).take(take), rb.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(seed.view(np.int64))], ["k1", "k2", "pos", "seed"])


def window_starts(pos: np.ndarray, n: int, window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """Starts of the windows of a text of n words that hold a seed at one of `pos`."""
    mark = np.zeros(n + 2, np.int32)
    np.add.at(mark, np.maximum(pos - (window - seed), 0), 1)
    np.add.at(mark, np.minimum(pos, n - window) + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: max(n - window + 1, 0)] > 0)


def lists(rb: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    col = rb.column(rb.schema.get_field_index(column))
    off = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), off - off[0]


def window_rows(batches):
    for rb in batches:
        values, cut = lists(rb, "pos")
        for lo, hi, data, off in text_steps(rb):
            starts, ends, first = w.spans(data, off)
            hashes = w.word_hashes(data, starts, ends)
            at = [window_starts(values[cut[i] : cut[i + 1]], int(first[i - lo + 1] - first[i - lo])) for i in range(lo, hi)]
            per = np.array([len(x) for x in at])
            doc = np.repeat(np.arange(hi - lo), per)
            rel = np.concatenate(at) if at else doc
            begin = first[doc] + rel
            h1 = w.run_hashes(hashes, begin, WINDOW).view(np.int64)
            h2 = w.run_hashes(w.word_hashes(data, starts, ends, 1), begin, WINDOW).astype(np.uint16).view(np.int16)
            take = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays([rb.column(0).take(take), rb.column(1).take(take), pa.array(rel.astype(np.int32)), pa.array(h1), pa.array(h2)], ["k1", "k2", "start", "h1", "h2"])


def covered(starts: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """For every word of a text of n words, whether a window at one of `starts` covers it."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return np.cumsum(mark)[:n] > 0


def kept_texts(batches):
    """Words, removed words, and the kept words joined by one space."""
    for rb in batches:
        values, cut = lists(rb, "starts")
        for lo, hi, data, off in text_steps(rb):
            starts, ends, first = w.spans(data, off)
            raw = data.tobytes()
            total, gone, texts = [], [], []
            for i in range(lo, hi):
                a, b, o = first[i - lo], first[i - lo + 1], off[i - lo]
                total.append(int(b - a))
                hit = values[cut[i] : cut[i + 1]]
                words = raw[o : off[i - lo + 1]].replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
                if len(hit):
                    cover = covered(hit, int(b - a))
                    gone.append(int(cover.sum()))
                    words = [x for x, c in zip(words, cover.tolist(), strict=True) if not c]
                else:
                    gone.append(0)
                texts.append(b" ".join(words))
            yield rb.slice(lo, hi - lo), total, gone, texts


def digest_rows(batches):
    for rb, total, gone, texts in kept_texts(batches):
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def text_rows(batches):
    """The row as it came, with its text cut where words went."""
    for rb, _, gone, texts in kept_texts(batches):
        old = rb.column(1).to_pylist()
        new = [x.decode() if g else t for x, g, t in zip(texts, gone, old, strict=True)]
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(new, pa.string()), pa.array(gone, pa.int64())], ["row", "text", "n_removed"])


def repeated_windows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """k1, k2, starts: for each text the words at which a repeated window of 35 words starts."""
    scratch = Scratch(spark, "substring")
    keyed = keys(documents(docs))
    anchors = scratch.table(keyed.select("k1", "k2", "text").mapInArrow(anchor_rows, "k1 long, k2 long, pos int, seed long"), "anchors")
    shared = anchors.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    # Written first: a join of two plain exchanges lets Spark split a seed that a third of all documents hold.
    shared = scratch.table(shared, "shared")
    places = anchors.join(shared, "seed", "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("pos"))
    places = scratch.table(places, "places")
    scratch.drop(anchors, shared)
    windows = keyed.join(places, ["k1", "k2"]).select("k1", "k2", "text", "pos").mapInArrow(window_rows, "k1 long, k2 long, start int, h1 long, h2 short")
    windows = scratch.table(windows, "windows")
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    again = scratch.table(again, "again")
    starts = windows.join(again, ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("start").alias("starts"))
    starts = scratch.table(starts, "starts")
    scratch.drop(windows, places, again)
    return starts


def keys(docs: DataFrame) -> DataFrame:
    """Null-safe keys of a row: its doc_id and a hash of its text."""
    return docs.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"))


def with_starts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    docs = documents(docs)
    found = repeated_windows(spark, docs)
    return keys(docs).join(found, ["k1", "k2"], "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))


def removed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per document."""
    return with_starts(spark, docs).select("doc_id", "text", "starts").mapInArrow(digest_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with all its columns; a text that loses words becomes its kept words joined by one space, n_chars (if there) follows."""
    found = repeated_windows(spark, docs)
    carried = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keys(carried).join(found, ["k1", "k2"], "left").select("row", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
    out = rows.mapInArrow(text_rows, T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
