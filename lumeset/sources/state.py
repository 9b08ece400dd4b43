"""A Spark data source for stored assessments: typed strictly, complete or not there, and kept apart by what they depend on.

Each task writes a file and tells its size and digest; only when all have is the completion record put in place, by one rename, so a failed task leaves
none. A read goes by the record: it fails without one, under another key, if a file is not as recorded, or if a field has another type. A folder
has a record, and later writes add to it.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FIELDS = {"key": int, "blog_score": float, "is_transition": bool, "scene": str, "reason": str}
SCHEMA = "key long, blog_score double, is_transition boolean, scene string, reason string"
RECORD = "_complete.json"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI or a path."""
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def record_of(folder: str) -> dict | None:
    store, path = opened(folder)
    if store.get_file_info(f"{path}/{RECORD}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{path}/{RECORD}") as f:
        return json.loads(f.read())


def typed(line: bytes) -> tuple:
    """A stored row; anything but the fields with their types is an error."""
    row = json.loads(line)
    if not isinstance(row, dict) or set(row) != set(FIELDS):
        raise ValueError(f"a stored row has other fields: {line[:200]!r}")
    for name, kind in FIELDS.items():
        if type(row[name]) is not kind:
            raise ValueError(f"{name} of a stored row is no {kind.__name__}: {line[:200]!r}")
    if not (math.isfinite(row["blog_score"]) and 0 <= row["blog_score"] <= 100):
        raise ValueError(f"a stored score is not between 0 and 100: {line[:200]!r}")
    return tuple(row[c] for c in FIELDS)


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    sha256: str
    rows: int


class StateWriter(DataSourceWriter):
    def __init__(self, folder: str, key: str, overwrite: bool):
        self.folder, self.key, self.overwrite = folder, key, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        lines = []
        for row in iterator:
            line = json.dumps({c: row[c] for c in FIELDS}, ensure_ascii=False).encode()
            typed(line)
            lines.append(line + b"\n")
        data, name = b"".join(lines), f"part-{uuid.uuid4().hex}.jsonl"
        if lines:
            store, path = opened(self.folder)
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(data)
        return Written(name, len(data), hashlib.sha256(data).hexdigest(), len(lines))

    def commit(self, messages: list[Written | None]) -> None:
        before = None if self.overwrite else record_of(self.folder)
        if before is not None and before["cache_key"] != self.key:
            raise ValueError(f"the folder holds assessments of {before['cache_key']}, not of {self.key}")
        files = (before or {"files": []})["files"] + [vars(m) for m in messages if m is not None and m.rows]
        store, path = opened(self.folder)
        store.create_dir(path, recursive=True)
        draft = f"{path}/_draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"cache_key": self.key, "files": files}, sort_keys=True).encode())
        store.move(draft, f"{path}/{RECORD}")

    def abort(self, messages: list[Written | None]) -> None:
        store, path = opened(self.folder)
        for m in messages:
            if m is not None and m.rows:
                store.delete_file(f"{path}/{m.name}")


class StateReader(DataSourceReader):
    def __init__(self, folder: str, key: str):
        self.folder, self.key = folder, key

    def partitions(self) -> list[InputPartition]:
        record = record_of(self.folder)
        if record is None:
            raise ValueError(f"no complete assessments in {self.folder}")
        if record["cache_key"] != self.key:
            raise ValueError(f"the stored assessments are of {record['cache_key']}, not of {self.key}")
        return [InputPartition(x) for x in record["files"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if (x := partition.value) is None:
            return
        store, path = opened(self.folder)
        with store.open_input_stream(f"{path}/{x['name']}") as f:
            data = f.read()
        if len(data) != x["size"] or hashlib.sha256(data).hexdigest() != x["sha256"]:
            raise ValueError(f"{x['name']} is not as it was recorded")
        for line in data.splitlines():
            yield typed(line)


class AssessmentState(DataSource):
    """Format ``assessment_state``; options: path (the folder) and cache_key."""

    @classmethod
    def name(cls) -> str:
        return "assessment_state"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> StateReader:
        return StateReader(self.options["path"], self.options["cache_key"])

    def writer(self, schema: StructType, overwrite: bool) -> StateWriter:
        return StateWriter(self.options["path"], self.options["cache_key"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AssessmentState)
