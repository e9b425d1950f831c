"""Written tables in the shared folder: the way lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a written table go when it is written, not when the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Arrow batches between the JVM and Python: at the default of 64 MB a task that takes and returns texts holds several
#: copies of such a batch on either side.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
WRITING = {CLEAN_UP: "true", BATCH: "8m"}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, one of our own.

    A local master shares its file system with its only executor, so a temporary folder serves
    there; on a cluster without the setting the warehouse is the folder that all nodes see.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            base = "file://" + os.path.join(tempfile.gettempdir(), "echoseq-work")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_echoseq_work"
    return f"{base.rstrip('/')}/{sc.applicationId}"


class Scratch:
    """Tables and folders of one operator call under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        self.paths.append(f"{self.root}/{len(self.paths)}-{name}")
        return self.paths[-1]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: lineage ends here, and a lost executor costs nothing before it."""
        path = self.path(name)
        conf = self.spark.conf
        was = {k: conf.get(k, None) for k in WRITING}
        for k, v in WRITING.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in was.items():
                conf.set(k, v) if v is not None else conf.unset(k)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for t in tables:
            self.delete(t._scratch_path)

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
