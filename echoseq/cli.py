"""Command line: python -m echoseq.cli COMMAND DIRECTORY [options]."""

from __future__ import annotations

import argparse
import select
import sys

from .operators.match import MatchParams
from .plans import jobs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echoseq")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **kind):
        c = sub.add_parser(name, **kind)
        c.add_argument("directory", nargs="?" if name == "continue" else None, default="." if name == "continue" else None)
        return c

    c = add("index", help="register and fingerprint new videos")
    c.add_argument("--fps", type=float, default=1.0)
    c.add_argument("--workers", type=int, default=4)
    c.add_argument("--no-audio", action="store_true")
    c.add_argument("--hwaccel", action="store_true")
    c, d = add("match", help="find duplicates and sub-clips"), MatchParams()
    c.add_argument("--filter-length", action="store_true")
    c.add_argument("--window", "--min-duration", type=float, default=d.window, help="least duration of the shorter video")
    c.add_argument("--frame-step", type=int, default=d.frame_step)
    c.add_argument("--threshold", type=int, default=d.threshold)
    c.add_argument("--min-confidence", type=float, default=d.min_confidence)
    c.add_argument("--workers", type=int, default=d.workers, help="accepted, inert")
    c.add_argument("--nprobe", type=int, default=d.nprobe, help="accepted, inert: the join is exact")
    c.add_argument("--dry-run", action="store_true")
    add("move", help="move groups into duplicates/N").add_argument("--dry-run", action="store_true")
    add("cleanup", help="drop deleted members, return single survivors")
    add("sync", help="drop records of missing files").add_argument("--dry-run", action="store_true")
    add("continue", help="run a saved command again").add_argument("which", nargs="?", choices=("index", "match"))
    return p


def quit_asked() -> bool:
    """Whether q was typed; work that is published stays, and the next run goes on."""
    try:
        return sys.stdin.isatty() and bool(select.select([sys.stdin], [], [], 0)[0]) and sys.stdin.readline().strip().lower() == "q"
    except (OSError, ValueError):
        return False


def main(argv: list[str] | None = None, spark=None) -> int:
    a = vars(parser().parse_args(argv))
    if spark is None:
        from .session import local_session

        spark = local_session()
    command, directory = a.pop("command"), a.pop("directory")
    try:
        if command == "continue":
            out = jobs.run_continue(spark, directory, a["which"], lambda names: input(f"Which run ({'/'.join(names)})? ").strip())
        else:
            stops = {"stop": quit_asked} if command in ("index", "match") else {}
            stops |= {"slices": 16} if command == "match" and sys.stdin.isatty() else {}
            out = getattr(jobs, f"run_{command}")(spark, directory, **a, **stops)
    except jobs.NoIndex as e:
        print(e, file=sys.stderr)
        return 1
    out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
