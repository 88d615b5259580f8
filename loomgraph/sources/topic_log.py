"""Message topics as a log of files on a shared mount: a stream reader with offsets, and a writer that commits by epoch.

A task writes its messages to files of its own, a file a topic. Committing an
epoch adds one manifest that names them, under the next free number, by a link
that fails where the number is taken: so manifests are numbered without gaps,
and an epoch is there whole or not at all. A manifest also names its writer and
epoch; an epoch that is committed again, after a failure, adds nothing. Offsets
are numbers of manifests, so a query that goes on from its checkpoint neither
loses nor repeats a message.

Messages of topics that a writer isn't told to serve, and null topics, are
dropped; null values and stamps stay null.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "topic string, value string, ts timestamp"


def _manifests(path: str) -> Path:
    return Path(path) / "manifests"


def _count(path: str) -> int:
    """Manifests so far: their numbers have no gaps."""
    return sum(p.suffix == ".json" for p in _manifests(path).iterdir()) if _manifests(path).is_dir() else 0


def _manifest(path: str, n: int) -> dict:
    return json.loads((_manifests(path) / f"{n:012d}.json").read_text())


@dataclass
class Segment(InputPartition):
    file: str
    topic: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # topic and file


def _segments(path: str, start: int, end: int, topics: set[str] | None) -> list[Segment]:
    return [Segment(file, topic) for n in range(start, end) for topic, file in _manifest(path, n)["files"] if topics is None or topic in topics]


def _messages(segment: Segment) -> Iterator[tuple]:
    with open(segment.file, encoding="utf-8") as f:
        for line in f:
            value, micros = json.loads(line)
            yield segment.topic, value, None if micros is None else datetime.fromtimestamp(micros // 1_000_000, UTC).replace(microsecond=micros % 1_000_000)


class _Batch(DataSourceReader):
    def __init__(self, path: str, topics: set[str] | None):
        self.path, self.topics = path, topics

    def partitions(self) -> list[Segment]:
        return _segments(self.path, 0, _count(self.path), self.topics) or [Segment("", "")]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _messages(partition) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, topics: set[str] | None, starting: str):
        self.path, self.topics, self.starting = path, topics, starting

    def initialOffset(self) -> dict:
        return {"next": _count(self.path) if self.starting == "latest" else 0}

    def latestOffset(self) -> dict:
        return {"next": _count(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return _segments(self.path, start["next"], end["next"], self.topics)

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _messages(partition)

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str, topics: set[str] | None, writer: str):
        self.path, self.topics, self.writer = path, topics, writer

    def write(self, iterator: Iterator) -> Written:
        folder = Path(self.path) / "data"
        folder.mkdir(parents=True, exist_ok=True)
        part, open_, files = uuid.uuid4().hex, {}, []
        try:
            for topic, value, ts in iterator:
                if topic is None or self.topics is not None and topic not in self.topics:
                    continue
                if topic not in open_:
                    files.append((topic, str(folder / f"{part}-{len(open_)}.jsonl")))
                    open_[topic] = open(files[-1][1], "w", encoding="utf-8")  # noqa: SIM115 - closed below
                micros = None if ts is None else round(ts.timestamp() * 1_000_000)
                open_[topic].write(json.dumps([value, micros]) + "\n")
        finally:
            for f in open_.values():
                f.close()
        return Written(files)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        _manifests(self.path).mkdir(parents=True, exist_ok=True)
        me = {"writer": self.writer, "epoch": batchId, "files": [f for m in messages if m for f in m.files]}
        n = _count(self.path)
        # epochs of a writer rise, so its last manifest tells whether this one is there
        for i in reversed(range(n)):
            known = _manifest(self.path, i)
            if known["writer"] == self.writer:
                if known["epoch"] >= batchId:
                    return self.abort(messages, batchId)
                break
        draft = Path(self.path) / f"draft-{uuid.uuid4().hex}"
        draft.write_text(json.dumps(me))
        while True:
            try:
                os.link(draft, _manifests(self.path) / f"{n:012d}.json")
                break
            except FileExistsError:
                n += 1
        draft.unlink()
        return None

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        for m in messages:
            for _, file in m.files if m else ():
                Path(file).unlink(missing_ok=True)


class TopicLog(DataSource):
    """``format("topic_log")`` with the options ``path``, ``topics`` (comma between), ``startingOffsets`` (``latest`` or ``earliest``) and, to write, ``writer``: a name that a query keeps over restarts."""

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return SCHEMA

    def _topics(self) -> set[str] | None:
        named = self.options.get("topics")
        return set(named.split(",")) if named else None

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"], self._topics())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self._topics(), self.options.get("startingOffsets", "latest"))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        if [f.name for f in schema] != ["topic", "value", "ts"]:
            raise ValueError("messages have the columns topic, value, ts")
        return _Writer(self.options["path"], self._topics(), self.options.get("writer", "writer"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicLog)
