"""Small tables with every awkward case: nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("key", "row", "k1", "starts", "size", "label", "id")]])


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def texts():
    """(doc_id, text, source)."""
    base, passage = words(1, 200), words(2, 60)
    out = [(1, " ".join(base), "a"), (2, " ".join(base), "a"), (3, " ".join(base[:100] + ["edit"] + base[101:]), "b")]
    out += [(4, None, "a"), (5, "", "b"), (6, " \t\n ", None), (7, "one two three", None), (8, "ONE two  three", "c"), (9, "çà É éé", "c")]
    out += [(10 + i, " ".join(words(10 + i, 50) + passage + words(50 + i, 40)), "ab"[i % 2]) for i in range(6)]
    out += [(20, " ".join(["same"] * 500), "a"), (21, " ".join(words(99, 30_000, 50_000)), "d"), (22, "x" * 200_000, "d")]
    # A family of copies with several edits each, and one row twice.
    out += [(30 + i, " ".join(w if random.Random(i * 1000 + k).random() > 0.01 else f"e{i}{k}" for k, w in enumerate(words(3, 300))), "e") for i in range(12)]
    return out


def documents(spark, rows=None, repeat=True, nulls=True):
    rows = texts() if rows is None else rows
    if repeat:
        rows = [*rows, rows[0]]
    if nulls:
        rows = [*rows, (None, "one two three", None), (None, None, None)]
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, "x", "y", None, "z", "s", "l", "i") for i, t, s in rows], DOCS)


def plain(rows):
    return sorted(rows, key=repr)
