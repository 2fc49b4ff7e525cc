"""Intermediate tables written to shared storage.

A staged table does four jobs in this library:

* it cuts lineage, so a lost executor costs a re-read and not a re-run;
* the shuffle files behind it go as soon as it is written, not when the driver's garbage
  collector happens to find them: steps that stage table after table hold one shuffle at a time;
* it fixes values that must not change between two uses (row positions after a range
  shuffle, see ``operators.rolling``);
* its size on disk is a measured fact. Spark broadcasts it when it is under
  ``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a sort-merge join whose sides
  are bare shuffles, which is the shape that AQE can split when one key is hot. So the
  library needs no broadcast hints.

A :class:`Stage` owns one folder. Results are lazy and read from it, so whoever made the stage
closes it when the results have been written or collected:

    with Stage(spark) as stage:
        run = audit.run(invoices, vendors, categories, stage)
        sinks.export_reports(run, folder)
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: list[tempfile.TemporaryDirectory] = []


def staging_root(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _local_dirs:
        _local_dirs.append(tempfile.TemporaryDirectory(prefix="voucherlens-"))
    return "file://" + _local_dirs[0].name


class Stage:
    """``stage(df, name)`` writes ``df`` as parquet and returns a scan of what was written."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.path = f"{root or staging_root(spark)}/voucherlens/{uuid.uuid4().hex}"
        self._n = 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:02d}_{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def _folder(self):
        """The stage's own folder and its file system, whichever Hadoop one that is."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def bytes_written(self) -> int:
        path, files = self._folder()
        return files.getContentSummary(path).getLength() if files.exists(path) else 0

    def close(self) -> None:
        """Deletes this stage's folder and nothing else. Its tables cannot be read afterwards."""
        path, files = self._folder()
        files.delete(path, True)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
