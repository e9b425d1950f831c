"""Versioned Parquet snapshots of the index tables in a hidden folder of the library, and JSON run configs.

A change writes new snapshots and then replaces one small manifest; readers see all of a change or
none. One writer at a time.
"""

from __future__ import annotations

import datetime
import json
import os
import tempfile
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from ..model import TABLES

FOLDER = ".index"
COMMANDS = ("index", "match")


def replace_json(path: str, value: dict) -> None:
    """Writes beside the target and moves into place; the temporary file goes on an error."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path), suffix=".tmp")
    try:
        with os.fdopen(fd, "w") as f:
            json.dump(value, f, indent=2)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def load_json(path: str) -> dict | None:
    try:
        with open(path) as f:
            out = json.load(f)
    except (OSError, ValueError):
        return None
    return out if isinstance(out, dict) else None


class Store:
    """The tables of one library directory. The directory is one that the driver and all executors see."""

    def __init__(self, spark: SparkSession, directory: str):
        if urlparse(directory).scheme not in ("", "file"):
            raise ValueError(f"the library must be a folder that driver and executors mount, not {directory}")
        self.spark, self.directory = spark, os.path.abspath(urlparse(directory).path)
        self.root = os.path.join(self.directory, FOLDER)

    # -- snapshots

    @property
    def manifest_path(self) -> str:
        return os.path.join(self.root, "manifest.json")

    def manifest(self) -> dict:
        return load_json(self.manifest_path) or {"version": 0, "tables": {}}

    def exists(self) -> bool:
        return os.path.exists(self.manifest_path)

    def read(self, name: str) -> DataFrame:
        parts = self.manifest()["tables"].get(name)
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"file://{self.root}/{p}" for p in parts])

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> int:
        """Publishes new snapshots: `replace` whole tables, `append` rows. Returns the version."""
        m = self.manifest()
        version = m["version"] + 1
        tables = dict(m["tables"])
        for name, df in {**(replace or {}), **(append or {})}.items():
            part = f"{name}/v{version}-{uuid.uuid4().hex[:8]}"
            df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in TABLES[name]]).write.parquet(f"file://{self.root}/{part}")
            tables[name] = [*tables.get(name, []), part] if name in (append or {}) else [part]
        replace_json(self.manifest_path, {"version": version, "written_at": time.time(), "tables": tables})
        return version

    def drop(self, *names: str) -> None:
        """Empties tables."""
        m = self.manifest()
        left = {k: v for k, v in m["tables"].items() if k not in names}
        replace_json(self.manifest_path, m | {"version": m["version"] + 1, "tables": left})

    def table_version(self, name: str) -> int:
        """The version of the last change of a table; 0 without one."""
        parts = self.manifest()["tables"].get(name, [])
        return max((int(p.rpartition("/v")[2].partition("-")[0]) for p in parts), default=0)

    def version(self) -> int:
        return self.manifest()["version"]

    # -- run configs

    def save_config(self, command: str, args: dict) -> None:
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        replace_json(os.path.join(self.root, f"{command}.json"), {"command": command, "last_run": now, "args": args})

    def load_config(self, command: str) -> dict | None:
        return load_json(os.path.join(self.root, f"{command}.json"))

    def configs(self) -> dict[str, dict]:
        return {c: x for c in COMMANDS if (x := self.load_config(c))}
