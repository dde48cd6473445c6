"""Session settings: what a local run needs, and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "engram", **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ENGRAM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only on a local master, where all tasks see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="engram-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


#: Rows that a task of a join over whole tables holds.
TASK_ROWS = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows. Ids compress well, so by bytes a task would get ever more of them; a stated number stays."""
    return max(spark.sparkContext.defaultParallelism, 1 + rows // TASK_ROWS)


def stored(df: DataFrame, what: str, build: Callable[[str], None]) -> str:
    """Folder of what ``build(path)`` derives from the files that ``df`` reads, in the shared checkpoint folder.

    It is named by ``what`` and by these files' names, sizes and times, and built when there is none yet.
    """
    spark = df.sparkSession
    files, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    seen = [what]
    for name in sorted(df.inputFiles()):
        status = files.Path(name).getFileSystem(conf).getFileStatus(files.Path(name))
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    path = f"{checkpoint_dir(spark).rstrip('/')}/engram-{what.split()[0]}-{hashlib.sha256(chr(10).join(seen).encode()).hexdigest()[:24]}"
    target = files.Path(path)
    store = target.getFileSystem(conf)
    if not store.exists(target):
        own = f"{path}-{uuid.uuid4().hex[:8]}"
        build(own)
        if store.exists(target) or not store.rename(files.Path(own), target):  # another session was first
            store.delete(files.Path(own), True)
    return path


class Scratch:
    """Tables of one run in the shared checkpoint folder, each deleted when what follows from it has been written.

    A written table cuts the lineage, outlives executors, is read by columns, and tells the optimizer its size. What is
    left goes with ``with Scratch(spark) as scratch`` at its end, else when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{checkpoint_dir(spark).rstrip('/')}/engram-{uuid.uuid4().hex}", {}
        self.folders: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the rows and read them again."""
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        if not self.paths:
            self._files(self.root)[0].deleteOnExit(self._files(self.root)[1])
        self.paths[path] = kept
        return kept

    def folder(self, name: str) -> str:
        """A folder of this run for what isn't a single table; it goes with the rest."""
        path = f"{self.root}/{name}"
        self._files(self.root)[0].deleteOnExit(self._files(self.root)[1])
        self.folders.append(path)
        return path

    def keep_new(self, df: DataFrame) -> DataFrame | None:
        """As ``keep``; None if there are no rows, which the writing itself counts."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count(F.lit(1)).alias("n")))
        if seen.get.get("n", 0):
            return kept
        self.drop(kept)
        return None

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for path in [p for p, df in self.paths.items() if any(df is k for k in kept)]:
            self._delete(path)
            self.paths[path] = None

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*(df for df in self.paths.values() if df is not None and not any(df is k for k in kept)))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop_all_but()
        for path in self.folders:
            self._delete(path)

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _delete(self, path: str) -> None:
        store, target = self._files(path)
        store.delete(target, True)
