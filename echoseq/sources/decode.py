"""Decoders: a path to frames' codes, duration and audio fingerprint, on the executors."""

from __future__ import annotations

import json
import shutil
import subprocess
import tempfile
import threading
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.hashing import phash

OUTPUT = "id long, path string, ok boolean, error string, duration double, frames array<struct<timestamp:double,phash:string>>, audio_duration double, audio string"


#: Seconds that a decoder may take beyond ten times the duration.
LEAST_SECONDS = 600


class Decoded(NamedTuple):
    duration: float
    frames: Iterator[np.ndarray]
    audio: tuple[float, str] | None


def ball(seed: int, t: float, h: int = 120, w: int = 160) -> np.ndarray:
    """A greyscale frame of a ball on a Lissajous path."""
    y, x = np.mgrid[:h, :w]
    cx, cy = w / 2 + w / 3 * np.sin((0.3 + seed % 13 * 0.1) * t), h / 2 + h / 3 * np.cos((0.3 + seed % 11 * 0.12) * t)
    return np.where((x - cx) ** 2 + (y - cy) ** 2 <= (10 + seed % 6 * 4) ** 2, 200, 60).astype(np.uint8)


def synthetic(path: str, fps: float = 1.0) -> Decoded:
    """Paths ball:<seed>:<seconds>."""
    _, seed, seconds = path.rsplit(":", 2)
    n = int(float(seconds) * fps)
    return Decoded(float(seconds), (ball(int(seed), i / fps) for i in range(n)), None)


def ffmpeg(path: str, fps: float = 1.0, hwaccel: bool = False, audio: bool = True) -> Decoded:
    """Greyscale frames through an ffmpeg pipe, one in memory at a time; an unreadable duration is 0."""
    if not shutil.which("ffmpeg") or not shutil.which("ffprobe"):
        raise RuntimeError("ffmpeg and ffprobe are needed on the executors to decode video files")
    probe = subprocess.run(["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", path], capture_output=True, text=True)
    try:
        duration = float(probe.stdout)
    except ValueError:
        duration = 0.0

    def frames():
        limit = LEAST_SECONDS + 10 * duration
        args = ["ffmpeg", "-v", "error", *(["-hwaccel", "auto"] if hwaccel else []), "-i", path, "-vf", f"fps={fps},scale=160:120", "-f", "rawvideo", "-pix_fmt", "gray", "-"]
        yield from raw_frames(args, limit)

    return Decoded(duration, frames(), chromaprint(path) if audio else None)


def raw_frames(args: list[str], limit: float, size: tuple[int, int] = (120, 160)) -> Iterator[np.ndarray]:
    """Greyscale frames that a command writes, one in memory at a time. Its messages go to a file, so they can't fill a pipe and
    stop it; after `limit` seconds it is killed, which is an error."""
    n = size[0] * size[1]
    with tempfile.TemporaryFile() as messages, subprocess.Popen(args, stdout=subprocess.PIPE, stderr=messages) as run:
        timer = threading.Timer(limit, run.kill)
        timer.start()
        try:
            while len(raw := run.stdout.read(n)) == n:
                yield np.frombuffer(raw, np.uint8).reshape(size)
            if code := run.wait():
                messages.seek(0)
                raise RuntimeError(f"exit {code}: {messages.read().decode(errors='replace')[-500:]}")
        finally:
            timer.cancel()
            run.kill()


def chromaprint(path: str) -> tuple[float, str] | None:
    """Duration and fingerprint by the fpcalc tool; None where that fails."""
    try:
        out = json.loads(subprocess.run(["fpcalc", "-json", path], capture_output=True, text=True, timeout=LEAST_SECONDS, check=True).stdout)
        return float(out["duration"]), str(out["fingerprint"])
    except (OSError, subprocess.SubprocessError, ValueError, KeyError, TypeError):
        return None


def process(videos: DataFrame, decoder: Callable[[str, float], Decoded] = ffmpeg, fps: float = 1.0) -> DataFrame:
    """videos (id, path) to OUTPUT; a failing file becomes a row with its error, and stays unprocessed."""

    def run(batches):
        # A row at a time: a task holds one video's codes.
        for pdf in batches:
            for i, path in zip(pdf["id"], pdf["path"], strict=True):
                try:
                    got = decoder(path, fps)
                    frames = [{"timestamp": k / fps, "phash": phash(f)} for k, f in enumerate(got.frames)]
                    row = (i, path, True, None, got.duration, frames, *(got.audio or (None, None)))
                except Exception as e:  # noqa: BLE001 - any failure of a file is its result
                    row = (i, path, False, str(e), None, None, None, None)
                yield pd.DataFrame([row], columns=["id", "path", "ok", "error", "duration", "frames", "audio_duration", "audio"])

    return videos.select("id", "path").mapInPandas(run, OUTPUT)


def synthetic_frames(rows: DataFrame) -> DataFrame:
    """(id, n) to the codes of n frames of the ball with seed id."""

    def run(batches):
        for pdf in batches:
            out = [(i, k, phash(ball(i, float(k)))) for i, n in zip(pdf["id"], pdf["n"], strict=True) for k in range(n)]
            yield pd.DataFrame(out, columns=["video_id", "frame_idx", "phash"])

    return rows.mapInPandas(run, "video_id long, frame_idx long, phash string")
