"""Documents of metrics as a Spark data source: a reader with a partition for each file,
a writer whose files count once the whole write has been committed.

A document is the JSON object of one subject: {"subject": ..., "metrics": [{"collector",
"metric", "value", "text"}, ...]}. Tasks write their documents to files of their own under
``_staged``; the commit moves those of the attempts that succeeded next to the others and
then writes the list of valid files. A reader takes the files of the list and no others,
so that a write that fails, or is cut off at any point, changes nothing.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "subject string, collector string, metric string, value double, text string"
_LIST, _STAGED = "_files.json", "_staged"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI: any that pyarrow knows."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(store: fs.FileSystem, root: str) -> list[str]:
    at = posixpath.join(root, _LIST)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return []
    with store.open_input_file(at) as f:
        return json.loads(f.read())["files"]


def _put(store: fs.FileSystem, at: str, value: Any) -> None:
    with store.open_output_stream(at) as f:
        f.write(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True).encode())


def _spelt(value: float | None) -> float | str | None:
    """JSON has no infinities and no NaN: they are words."""
    return value if value is None or math.isfinite(value) else str(value)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class OneFile(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [OneFile(name) for name in _listed(*_store(self.path))] or [OneFile("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, root = _store(self.path)
        if not partition.value:
            return
        with store.open_input_file(posixpath.join(root, partition.value)) as f:
            documents = json.loads(f.read())
        for d in documents:
            for m in d["metrics"]:
                yield d["subject"], m["collector"], m["metric"], None if m["value"] is None else float(m["value"]), m["text"]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """One file of documents for each task that has rows. Rows of one subject that
        follow each other are one document."""
        store, root = _store(self.path)
        documents = []
        for subject, rows in groupby(iterator, key=lambda r: r.subject):
            documents.append({"subject": subject, "metrics": [{"collector": r.collector, "metric": r.metric, "value": _spelt(r.value), "text": r.text} for r in rows]})
        if not documents:
            return Written([])
        name = f"{self.run}-{uuid.uuid4().hex}.json"
        store.create_dir(posixpath.join(root, _STAGED, self.run))
        _put(store, posixpath.join(root, _STAGED, self.run, name), documents)
        return Written([name])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        new = sorted(name for m in messages if m for name in m.files)
        store.create_dir(root)
        old = _listed(store, root)
        for name in new:
            store.move(posixpath.join(root, _STAGED, self.run, name), posixpath.join(root, name))
        _put(store, posixpath.join(root, f"{_LIST}.{self.run}"), {"files": new if self.overwrite else old + new})
        store.move(posixpath.join(root, f"{_LIST}.{self.run}"), posixpath.join(root, _LIST))
        self._clear(store, root)
        if self.overwrite:
            for name in old:
                store.delete_file(posixpath.join(root, name))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        """Staged files, those of attempts that failed included."""
        at = posixpath.join(root, _STAGED, self.run)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class MetricDocuments(DataSource):
    """Options: path, a folder."""

    @classmethod
    def name(cls) -> str:
        return "metric_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], overwrite)


def write(metrics: DataFrame, path: str, *, mode: str = "append") -> None:
    """Write metrics (subject, collector, metric, value, text) as documents. All rows of
    a subject go to one task: a subject has as many as there are metrics."""
    metrics.sparkSession.dataSource.register(MetricDocuments)
    rows = metrics.select("subject", "collector", "metric", "value", "text")
    rows.repartition("subject").sortWithinPartitions("subject", "collector", "metric").write.format("metric_documents").mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MetricDocuments)
    return spark.read.format("metric_documents").load(path)
