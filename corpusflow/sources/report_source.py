"""Reports as a data source: ``spark.read``, ``spark.readStream`` and ``df.write`` with ``format("corpusflow_report")``.

A report is a folder. ``parts/`` holds files of JSON lines, one a task that had rows; ``manifest/<number>.json`` holds one
commit: its parts, its number of rows, the columns, and whether it replaces what was there. Readers see the parts that
commits name, those since the last replacing one. Tasks write parts under names of their own, and only the commit of the
whole write names them: a write that fails, or a task that runs twice, leaves nothing visible. A stream has a commit's number
as offset, so each commit is read once.

Paths are opened on the executors by URI, so the folder has to be one that all of them share.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "corpusflow_report"


class Folder:
    """A folder of some file system, by URI or local path."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.system, self.path = fs.FileSystem.from_uri(self.uri)

    def names(self, below: str) -> list[str]:
        listed = self.system.get_file_info(fs.FileSelector(f"{self.path}/{below}", allow_not_found=True))
        return sorted(x.base_name for x in listed if x.is_file and not x.base_name.startswith("."))

    def write(self, name: str, data: bytes) -> None:
        self.system.create_dir(f"{self.path}/{name}".rsplit("/", 1)[0])
        with self.system.open_output_stream(f"{self.path}/{name}") as out:
            out.write(data)

    def read(self, name: str) -> bytes:
        with self.system.open_input_stream(f"{self.path}/{name}") as source:
            return source.read()

    def remove(self, name: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            self.system.delete_file(f"{self.path}/{name}")


def commits(folder: Folder, after: int = 0, upto: int | None = None) -> list[dict]:
    """Commits with numbers in (after, upto], in order."""
    numbers = [int(n.removesuffix(".json")) for n in folder.names("manifest")]
    return [json.loads(folder.read(f"manifest/{n:09d}.json")) | {"number": n} for n in numbers if n > after and (upto is None or n <= upto)]


def visible(found: list[dict]) -> list[str]:
    """Parts since the last replacing commit."""
    parts: list[str] = []
    for c in found:
        parts = [*([] if c["replaces"] else parts), *c["parts"]]
    return parts


class Part(InputPartition):
    def __init__(self, name: str):
        self.name = name


def rows_of(uri: str, part: str, columns: Sequence[str]) -> Iterator[tuple]:
    for line in Folder(uri).read(f"parts/{part}").splitlines():
        held = json.loads(line)
        yield tuple(held.get(c) for c in columns)


class ReportReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType):
        self.uri, self.columns = uri, schema.fieldNames()

    def partitions(self) -> list[Part]:
        return [Part(p) for p in visible(commits(Folder(self.uri)))]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from rows_of(self.uri, partition.name, self.columns) if partition else ()


class ReportStream(DataSourceStreamReader):
    def __init__(self, uri: str, schema: StructType):
        self.uri, self.columns = uri, schema.fieldNames()

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        return {"number": max((int(n.removesuffix(".json")) for n in Folder(self.uri).names("manifest")), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(p) for c in commits(Folder(self.uri), start["number"], end["number"]) for p in c["parts"]]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from rows_of(self.uri, partition.name, self.columns)


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    rows: int


class ReportWriter(DataSourceWriter):
    def __init__(self, uri: str, schema: StructType, replaces: bool):
        self.uri, self.columns, self.schema, self.replaces = uri, schema.fieldNames(), schema.json(), replaces

    def write(self, iterator: Iterator[Row]) -> Written:
        lines = [json.dumps({c: row[c] for c in self.columns if row[c] is not None}, default=str, ensure_ascii=False) for row in iterator]
        if not lines:
            return Written(None, 0)
        part = f"{uuid.uuid4().hex}.jsonl"
        Folder(self.uri).write(f"parts/{part}", "\n".join(lines).encode())
        return Written(part, len(lines))

    def commit(self, messages: list[Written | None]) -> None:
        folder, done = Folder(self.uri), [m for m in messages if m is not None]
        number = max((int(n.removesuffix(".json")) for n in folder.names("manifest")), default=0) + 1
        entry = {"parts": [m.part for m in done if m.part], "rows": sum(m.rows for m in done), "replaces": self.replaces, "schema": self.schema}
        folder.write(f"manifest/{number:09d}.json", json.dumps(entry).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.part:
                Folder(self.uri).remove(f"parts/{m.part}")


class ReportSource(DataSource):
    """Options: ``path``. Without a schema that of the last commit is read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        found = commits(Folder(self.options["path"]))
        if not found:
            raise ValueError("the report has no commit yet: give a schema")
        return StructType.fromJson(json.loads(found[-1]["schema"]))

    def reader(self, schema: StructType) -> ReportReader:
        return ReportReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> ReportStream:
        return ReportStream(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReportSource)
