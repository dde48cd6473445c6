"""Scenario files as a data source: ``spark.read.format("engram_scenarios").load(folder)``, a partition for each file.

Rows are ``file, scenario, pattern, kind, after, value``: turns (value: day and text), checkpoints, erasures and
preconditions in their order. A file that isn't a YAML mapping, or lacks what a scenario needs, stops the read with an error
that names the file. Folders may lie wherever Arrow's file systems reach. An empty folder gives no rows.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, scenario string, pattern string, kind string, after int, value string"


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def rows_of(name: str, text: str) -> Iterator[tuple]:
    """Rows of one file."""
    import yaml

    from engram.evals.suite import _of_yaml

    stem = posixpath.splitext(posixpath.basename(name))[0]
    try:
        raw = yaml.safe_load(text)
        if not isinstance(raw, dict):
            raise TypeError(f"a mapping is expected, not {type(raw).__name__}")
        scenario = _of_yaml(stem, raw)
    except (yaml.YAMLError, KeyError, TypeError, AttributeError) as wrong:
        raise ValueError(f"{name}: {type(wrong).__name__}: {wrong}") from wrong
    head = (name, scenario["id"], scenario["pattern"])
    told = lambda x: json.dumps(x, ensure_ascii=False)
    for n, turn in enumerate(scenario["turns"], 1):
        yield (*head, "turn", n, told(turn))
    for kind, key in (("checkpoint", "checkpoints"), ("erasure", "erasures")):
        for item in scenario[key]:
            yield (*head, kind, item["after"], told({k: v for k, v in item.items() if k != "after"}))
    for item in scenario["preconditions"]:
        yield (*head, "precondition", None, told(item))


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def _at(self, path: str) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        store, folder = self._at(self.folder)
        found = store.get_file_info(pyarrow.fs.FileSelector(folder))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.extension in ("yaml", "yml")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # a folder without files
            return
        store, _ = self._at(self.folder)
        with store.open_input_stream(partition.path) as file:
            yield from rows_of(partition.path, file.read().decode("utf-8"))


class ScenarioSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "engram_scenarios"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("name a folder of scenario files")
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScenarioSource)
