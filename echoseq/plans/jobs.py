"""The commands: index, match, move, cleanup, sync, continue. Heavy work is DataFrames; the driver moves files and swaps manifests."""

from __future__ import annotations

import os
import shutil
import sys
import time
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import from_hex
from ..operators import match, organise, reconcile, tables
from ..scratch import Scratch
from ..sources import decode, files, search_index
from ..sources.store import Store

#: Videos that are published at once, and tasks at most that decode them.
CHUNK, MOST_TASKS = 100_000, 20_000


class NoIndex(RuntimeError):
    """The directory has no index."""


def need(store: Store) -> Store:
    if not store.exists():
        raise NoIndex(f"no index under {store.directory}; run index first")
    return store


def never() -> bool:
    return False


def run_index(spark: SparkSession, directory: str, fps: float = 1.0, workers: int = 4, no_audio: bool = False, hwaccel: bool = False, decoder: Callable | None = None, paths: DataFrame | None = None, chunk: int = CHUNK, stop: Callable[[], bool] = never) -> DataFrame:
    """Registers new videos and processes unprocessed ones, `chunk` of them to a published change, so a run that ends early, by
    `stop` or otherwise, keeps the chunks that are done. A task decodes few videos; `workers` is the least number of tasks.
    Returns (path, error) of those that failed; they are tried again next time."""
    store, scratch = Store(spark, directory), Scratch(spark, "index")
    known = store.read("videos")
    new = tables.register(known, paths if paths is not None else files.find_videos(spark, store.directory))
    store.commit(replace={"videos": scratch.table(known.unionByName(new), "videos")})
    store.save_config("index", {"fps": fps, "workers": workers, "no_audio": no_audio, "hwaccel": hwaccel})
    decoder = decoder or (lambda path, rate: decode.ffmpeg(path, rate, hwaccel, not no_audio))
    todo = scratch.table(tables.in_order(tables.unprocessed(store.read("videos")), [F.col("id")]), "todo")
    n, failed = todo.count(), []
    for lo in range(0, n, chunk):
        if stop():
            break
        some = todo.where((F.col("before") >= lo) & (F.col("before") < lo + chunk))
        part = some.select("id", "path").repartitionByRange(max(1, workers, min(n - lo, chunk, MOST_TASKS)), "id")
        done = scratch.table(decode.process(part, decoder, fps), "done")
        publish(store, done.where("ok"), time.time())
        failed.append(done.where("not ok").select("path", "error"))
    return reduce(DataFrame.unionByName, failed) if failed else spark.createDataFrame([], "path string, error string")


def publish(store: Store, ok: DataFrame, now: float) -> None:
    """One change with the results of processed videos: their rows, frames and audio."""
    videos = store.read("videos")
    hit = F.col("new_duration").isNotNull()
    videos = videos.join(ok.select("id", F.col("duration").alias("new_duration")), "id", "left").select("id", "path", F.when(hit, F.col("new_duration")).otherwise(F.col("duration")).alias("duration"), F.when(hit, F.lit(now)).otherwise(F.col("fingerprinted_at")).alias("fingerprinted_at"), "moved_to")
    rows = ok.select(F.col("id").alias("video_id"), F.posexplode("frames").alias("frame_idx", "f")).select("video_id", "frame_idx", "f.timestamp", "f.phash", from_hex("f.phash").alias("h"))
    audio = ok.where("audio is not null").select(F.col("id").alias("video_id"), F.col("audio_duration").alias("duration"), F.col("audio").alias("fingerprint"))
    store.commit(replace={"videos": videos, "audio_fingerprints": tables.upsert(store.read("audio_fingerprints"), audio, ["video_id"])}, append={"frame_hashes": rows})


def load_videos(videos: DataFrame, frames: DataFrame, audio: DataFrame) -> DataFrame:
    """Processed videos with n_frames and has_audio."""
    n = frames.groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("n_frames"))
    heard = audio.select(F.col("video_id").alias("id"), F.lit(True).alias("has_audio")).distinct()
    done = videos.where("fingerprinted_at is not null").join(n, "id", "left").join(heard, "id", "left")
    return done.select("id", "path", "duration", F.coalesce("n_frames", F.lit(0)).alias("n_frames"), F.coalesce("has_audio", F.lit(False)).alias("has_audio"))


def run_match(spark: SparkSession, directory: str, dry_run: bool = False, slices: int = 1, stop: Callable[[], bool] = never, **args) -> DataFrame:
    """Compares uncompared candidates and appends matches; returns the new matches (short_id, long_id, match_type, confidence).

    Candidates are the pairs that a telling frame of the shorter video votes for (`match.starts`). They are compared in `slices`
    parts, each published by itself, so a run that ends early keeps the parts that are done and the next run goes on with the rest.
    """
    p = match.MatchParams(**args)
    store, scratch = need(Store(spark, directory)), Scratch(spark, "match")
    search_index.build(store, p.threshold)
    frames = store.read("frame_hashes")
    videos = scratch.table(load_videos(store.read("videos"), frames, store.read("audio_fingerprints")), "videos")
    frames = scratch.table(frames.join(videos.select(F.col("id").alias("video_id")), "video_id", "left_semi"), "frames")
    # Pairs under the window are candidates too: they are recorded as compared without being scored.
    tested = scratch.table(match.starts(frames, videos, replace(p, window=0.0), store.read("comparisons"), search_index.near(store, p.threshold)), "starts")
    found = []
    for k in range(slices):
        if stop():
            break
        part = tested if slices == 1 else tested.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k)
        best = scratch.table(match.best_of(match.score(part.where(F.col("short_duration") >= p.window), frames, p.threshold)), "best")
        found.append(scratch.table(match.matched(best, p), "found"))
        if not dry_run:
            record(store, part.select(F.col("a").alias("video_a_id"), F.col("b").alias("video_b_id")).distinct(), found[-1])
    if not dry_run:
        store.save_config("match", p.args())
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "short_id long, long_id long, match_type string, confidence double")


def record(store: Store, compared: DataFrame, found: DataFrame) -> None:
    """One change with compared pairs, new candidates, and matches with ids that go on from the highest."""
    rows = new_matches(store.read("matches"), found, time.time())
    new = compared.join(store.read("candidate_pairs"), ["video_a_id", "video_b_id"], "left_anti")
    store.commit(append={"comparisons": compared, "matches": rows, "candidate_pairs": new})


def new_matches(old: DataFrame, found: DataFrame, now: float) -> DataFrame:
    """Rows of `matches` for found pairs, in the order of their videos."""
    top = old.agg(F.max("id")).first()[0] or 0
    keyed = tables.in_order(found, [F.col("short_id"), F.col("long_id")])
    return keyed.select((F.col("before") + top + 1).cast("long").alias("id"), F.col("short_id").alias("video_a_id"), F.col("long_id").alias("video_b_id"), "match_type", "confidence", F.lit(now).alias("found_at"), F.lit(0).alias("moved"))


def free_name(path: str, suffix: str) -> str:
    """path, or with a suffix before the ending if it is taken."""
    stem, ext = os.path.splitext(path)
    return path if not os.path.exists(path) else f"{stem}{suffix}{ext}"


def run_move(spark: SparkSession, directory: str, dry_run: bool = False) -> DataFrame:
    """Moves the files of each group into duplicates/N. Returns the plan, or with dry_run its summary."""
    store, scratch = need(Store(spark, directory)), Scratch(spark, "move")
    root = os.path.join(store.directory, files.GROUPS)
    videos, matches = store.read("videos"), store.read("matches")
    members = organise.groups(matches, scratch.table)
    if dry_run:
        return organise.summary(members)
    on_disk = [int(x) for x in os.listdir(root) if x.isdigit()] if os.path.isdir(root) else []
    base = max([organise.next_base(videos, root), *on_disk])
    plan = scratch.table(organise.move_plan(organise.numbered(members, matches, base), videos, root, files.listing(spark, store.directory)), "plan")
    for r in plan.orderBy("group_id", "video_id").toLocalIterator():
        os.makedirs(os.path.dirname(r["target"]), exist_ok=True)
        shutil.move(r["source"], free_name(r["target"], f"_{r['video_id']}"))
    placed = plan.select(F.col("video_id").alias("id"), "target")
    videos = videos.join(placed, "id", "left").select("id", "path", "duration", "fingerprinted_at", F.coalesce("target", "moved_to").alias("moved_to"))
    store.commit(replace={"videos": videos, "matches": tables.flag_pairs(matches, placed.select("id"), 1)})
    return plan


def run_cleanup(spark: SparkSession, directory: str) -> DataFrame:
    """Drops records of files deleted from groups and returns single survivors. One row: groups, deleted, returned."""
    store, scratch = need(Store(spark, directory)), Scratch(spark, "cleanup")
    root = os.path.join(store.directory, files.GROUPS)
    videos, there = store.read("videos"), scratch.table(files.listing(spark, store.directory), "listing")
    outcomes = scratch.table(reconcile.group_outcomes(videos, there, root), "outcomes")
    back = scratch.table(reconcile.return_plan(videos, outcomes, there), "back")
    gone = scratch.table(reconcile.deleted_members(videos, there, root), "gone")
    for r in back.toLocalIterator():
        os.makedirs(os.path.dirname(r["target"]), exist_ok=True)
        shutil.move(r["source"], r["target"])
        if not os.listdir(os.path.dirname(r["source"])):
            os.rmdir(os.path.dirname(r["source"]))
    left = reconcile.cascade_delete({n: store.read(n) for n in reconcile.DEPENDENTS}, gone)
    home = back.select("id", "target")
    left["videos"] = left["videos"].join(home, "id", "left").select("id", F.coalesce("target", "path").alias("path"), "duration", "fingerprinted_at", F.when(F.col("target").isNull(), F.col("moved_to")).alias("moved_to"))
    left["matches"] = tables.flag_pairs(left["matches"], home.select("id"), 0, both=False)
    store.commit(replace=left)
    return outcomes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n_deleted"), F.lit(0)).alias("deleted"), F.count("returned_id").alias("returned"))


def run_sync(spark: SparkSession, directory: str, dry_run: bool = False) -> DataFrame:
    """Drops records of videos whose files are nowhere; returns them (id, path)."""
    store, scratch = need(Store(spark, directory)), Scratch(spark, "sync")
    gone = scratch.table(reconcile.missing(store.read("videos"), files.listing(spark, store.directory)).select("id", "path"), "missing")
    if not dry_run and not gone.isEmpty():
        store.commit(replace=reconcile.cascade_delete({n: store.read(n) for n in reconcile.DEPENDENTS}, gone))
    return gone


def run_continue(spark: SparkSession, directory: str, command: str | None = None, choose: Callable[[list[str]], str] | None = None, **index_options) -> DataFrame:
    """Runs a saved command again. With several saved ones and none named, choose(names) decides. Before a match whose index has changed since, the search index is dropped and so built again."""
    store = need(Store(spark, directory))
    saved = store.configs()
    if command is None and len(saved) > 1 and choose:
        command = choose(sorted(saved))
    command = command or next(iter(saved), None)
    if command not in saved:
        raise NoIndex(f"no saved run of {command or 'any command'}")
    args = saved[command].get("args", {})
    if command == "index":
        return run_index(spark, directory, **args, **index_options)
    if is_stale(spark, directory):
        print("the index has changed since the last match; the search index is built again", file=sys.stderr)
        search_index.invalidate(store)
    return run_match(spark, directory, **args)


def is_stale(spark: SparkSession, directory: str) -> bool:
    """Whether videos were indexed after the last match."""
    store = need(Store(spark, directory))
    last = (store.load_config("match") or {}).get("last_run", "")
    return bool(last) and reconcile.is_stale(store.read("videos"), last).first()[0]
