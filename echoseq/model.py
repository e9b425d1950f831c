"""Schemas of the index tables. A video is any item that is reduced to an ordered sequence of 64-bit codes."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


L, D, S, I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()  # noqa: E741

VIDEOS = struct(("id", L, False), ("path", S, False), ("duration", D, True), ("fingerprinted_at", D, True), ("moved_to", S, True))
FRAME_HASHES = struct(("video_id", L, False), ("frame_idx", L, False), ("timestamp", D, False), ("phash", S, False), ("h", L, False))
AUDIO_FINGERPRINTS = struct(("video_id", L, False), ("duration", D, True), ("fingerprint", S, True))
COMPARISONS = struct(("video_a_id", L, False), ("video_b_id", L, False))
CANDIDATE_PAIRS = COMPARISONS
MATCHES = struct(("id", L, False), ("video_a_id", L, False), ("video_b_id", L, False), ("match_type", S, False), ("confidence", D, False), ("found_at", D, False), ("moved", I, False))
INDEX_META = struct(("id", I, False), ("built_at", D, True), ("version", L, True), ("threshold", I, True), ("codes", L, True))
INDEX_BLOCKS = struct(("band", I, False), ("cell", L, False), ("probe", I, False), ("n", L, False), ("codes", T.BinaryType(), False))

TABLES = {"videos": VIDEOS, "frame_hashes": FRAME_HASHES, "audio_fingerprints": AUDIO_FINGERPRINTS, "comparisons": COMPARISONS, "candidate_pairs": CANDIDATE_PAIRS, "matches": MATCHES, "index_meta": INDEX_META, "index_blocks": INDEX_BLOCKS}
