"""Versioned Parquet storage of subject memories: copy on write per bucket, one manifest per version, one writer.

A commit writes the touched buckets into a new version folder and then creates its manifest, which fails if another
writer has created that version; readers hold the manifest that they opened (the newest that is whole), so a read is one
snapshot. The first commit fixes the number of buckets by its number of subjects. ``vacuum`` deletes what no current manifest names, which is what
makes an erasure physical. All file access goes through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.sources import migrations

#: Least number of buckets, and subjects of a bucket on average when a store is made.
BUCKETS, SUBJECTS = 16, 2000
_SCHEMA = "subject_id string, memory string, bucket int"


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        found = self.manifest()
        self.fixed = found is not None or buckets is not None
        self.buckets = found["buckets"] if found else buckets or BUCKETS

    def manifest(self) -> dict | None:
        """The newest manifest: version and, for each bucket that has rows, the version that wrote it."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        for name in reversed(names):
            stream = self._fs.open(self._path(f"{self.root}/manifest/{name}"))
            try:
                return json.loads(self._io.toString(stream, "UTF-8"))
            except ValueError:  # being written, or left by a writer that was lost
                continue
            finally:
                stream.close()
        return None

    def bucket(self, subject: str = "subject_id"):
        return F.pmod(F.xxhash64(subject), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """``subject_id, memory, bucket`` of one snapshot; ``only``: of these buckets (partition pruning by path)."""
        current = (self.manifest() or {"files": {}})["files"]
        paths = [f"{self.root}/data/v{v}/bucket={b}" for b, v in current.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema("subject_id string, memory string").parquet(*paths)
        return rows.withColumn("bucket", self.bucket())

    def read_subject(self, subject: str | None) -> DataFrame:
        """As ``read``; of one subject only its bucket's files are read."""
        if subject is None or not self.manifest():
            return self.read()
        own = self.spark.range(1).select(F.lit(subject).alias("subject_id")).select(self.bucket()).first()[0]
        return self.read([own]).filter(F.col("subject_id") == subject)

    def applied(self) -> dict[str, str]:
        """Migration steps that the stored memories have, with their checksums; a new store has all."""
        found = self.manifest()
        return found.get("applied", {}) if found else migrations.checksums()

    def migrate(self) -> list[str]:
        """Apply the steps that are pending to all memories; their names."""
        names = migrations.pending(self.applied())
        if names:
            rows = self.read().select("subject_id", "memory")
            for name in names:
                rows = rows.withColumn("memory", F.expr(migrations.STEPS[name]))
            self.commit(rows, self.applied() | migrations.checksums())
        return names

    def commit(self, changed: DataFrame, applied: dict[str, str] | None = None) -> int:
        """Replace or add the memories of subjects (``subject_id, memory``); a null memory removes the subject."""
        held = changed.select("subject_id", "memory").persist()
        changed = held
        try:
            if not self.fixed:
                self.buckets, self.fixed = max(BUCKETS, changed.count() // SUBJECTS), True
            changed = changed.withColumn("bucket", self.bucket())
            touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            before = self.manifest() or {"version": 0, "files": {}}
            version = before["version"] + 1
            kept = self.read(touched).join(changed.select("subject_id"), "subject_id", "left_anti").select("subject_id", "memory", "bucket")
            rows = kept.unionByName(changed.filter("memory IS NOT NULL"))
            rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/data/v{version}")
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/data/v{version}"))]
            there = {n.split("=")[1] for n in names if n.startswith("bucket=")}
            files = {b: v for b, v in before["files"].items() if int(b) not in touched} | dict.fromkeys(sorted(there), version)
            self._publish({"version": version, "buckets": self.buckets, "files": files, "applied": applied or self.applied()})
            return version
        finally:
            held.unpersist()

    def _publish(self, manifest: dict) -> None:
        final = self._path(f"{self.root}/manifest/{manifest['version']:012d}.json")
        try:
            stream = self._fs.create(final, False)  # never overwrites
        except Py4JJavaError as problem:
            raise RuntimeError(f"version {manifest['version']} was committed by another writer") from problem
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    def vacuum(self) -> None:
        """Delete old manifests and all data that the newest one doesn't name."""
        current = self.manifest()
        if current is None:
            return
        live = {(v, int(b)) for b, v in current["files"].items()}
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            if s.getPath().getName() != f"{current['version']:012d}.json":
                self._fs.delete(s.getPath(), True)
        for version in self._fs.listStatus(self._path(f"{self.root}/data")):
            number = int(version.getPath().getName()[1:])
            parts = [p for p in self._fs.listStatus(version.getPath()) if p.getPath().getName().startswith("bucket=")]
            dead = [p for p in parts if (number, int(p.getPath().getName().split("=")[1])) not in live]
            for p in [version] if len(dead) == len(parts) else dead:
                self._fs.delete(p.getPath(), True)
