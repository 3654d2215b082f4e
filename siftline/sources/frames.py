"""Frames: lines of files as rows, with a bound on what is read before a row is built, as a batch and a streaming source and as a sink that commits whole jobs or nothing.

Register with spark.dataSource.register(FrameSource), then use format("frames"). Paths are what pyarrow's file systems open (a URI, or a path that all executors share).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.gates import MAX_FRAME_BYTES

BLOCK = 1 << 20
TOO_LARGE = "frame too large"


def _files(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[int, str, int]]:
    """(time, name, size) of the files below path, in order of time and name; hidden ones and those of folders that begin with _ aren't."""
    from pyarrow import fs

    system, root = _files(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    whole = [system.get_file_info(root)] if not found else found
    shown = lambda f: not any(x[:1] in ("_", ".") for x in f.path[len(root) :].split("/"))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in whole if f.type == fs.FileType.File and shown(f))


@dataclass
class Stretch(InputPartition):
    path: str
    name: str
    start: int
    end: int


def frames(stream, start: int, end: int, most: int) -> Iterator[tuple[int, bytes | None]]:
    """(place, bytes) of the lines that begin in [start, end) of a file; None for a line of more than `most` bytes, of which no more than that and a block is ever held."""
    at = max(0, start - 1)
    stream.seek(at)
    held, begin, over, skipping = bytearray(), at, False, start > 0  # a line that began before start belongs to the stretch before
    while True:
        data = stream.read(BLOCK)
        cut = 0
        while (stop := data.find(b"\n", cut)) >= 0:
            if skipping:
                skipping = False
            else:
                over = over or len(held) + stop - cut > most
                yield begin, None if over else bytes(held) + data[cut:stop]
            held, over, cut = bytearray(), False, stop + 1
            begin = at + cut
            if begin >= end:
                return
        if not skipping and not over:
            held += data[cut:]
            if len(held) > most:
                held, over = bytearray(), True
        at += len(data)
        if not data:
            break
    if not skipping and (held or over):
        yield begin, None if over else bytes(held)


class _Reading:
    def __init__(self, options: dict):
        self.path, self.most, self.split = options["path"], int(options.get("maxFrameBytes", MAX_FRAME_BYTES)), int(options.get("splitBytes", 64 << 20))

    def stretches(self, files: list[tuple[int, str, int]]) -> list[Stretch]:
        return [Stretch(self.path, name, k, min(k + self.split, size)) for _, name, size in files for k in range(0, size, self.split)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        system, _ = _files(part.path)
        with system.open_input_file(part.name) as stream:
            for pos, data in frames(stream, part.start, part.end, self.most):
                yield part.name, pos, None if data is None else data.decode("utf-8", "replace"), TOO_LARGE if data is None else None


class FrameReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return self.stretches(_listed(self.path)) or [Stretch(self.path, "", 0, 0)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        return super().read(part) if part.end else iter(())


class FrameStream(_Reading, DataSourceStreamReader):
    """Files as they come, in order of their time and name; a file that is there is taken to be complete."""

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        between = lambda f: (start["time"], start["name"]) < f[:2] <= (end["time"], end["name"])
        return self.stretches([f for f in _listed(self.path) if between(f)])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class FrameWriter(DataSourceWriter, DataSourceStreamWriter):
    """JSON lines with their keys in order. A task writes a hidden file; the files of a job that succeeds are renamed, those of one that fails deleted. A streaming batch's files have names of the batch
    and the task, and a batch that is committed has a mark, so one that is run again adds nothing."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = _files(self.path)
        system.create_dir(f"{root}/_pending-{self.job}", recursive=True)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.jsonl", 0
        with system.open_output_stream(f"{root}/_pending-{self.job}/{name}") as out:
            for row in rows:
                values = row.asDict(recursive=True)
                line = values["frame"] if list(values) == ["frame"] else json.dumps(values, sort_keys=True, ensure_ascii=False, default=str)
                out.write(f"{line}\n".encode())
                n += 1
        return Written(f"_pending-{self.job}/{name}" if n else None)

    def _settle(self, messages: list, prefix: str, mark: str | None) -> None:
        from pyarrow import fs

        system, root = _files(self.path)
        done = mark is not None and system.get_file_info(f"{root}/_committed/{mark}").type == fs.FileType.File
        names = [] if done else sorted(m.name for m in messages if m is not None and m.name)
        for k, name in enumerate(names):
            system.move(f"{root}/{name}", f"{root}/{prefix}-{k:05d}.jsonl")
        if mark is not None and not done:
            system.create_dir(f"{root}/_committed", recursive=True)
            with system.open_output_stream(f"{root}/_committed/{mark}") as out:
                out.write(b"\n".join(n.encode() for n in names))
        # a stream's tasks have a writer of their own, so their folder is known from what they say
        for pending in {f"_pending-{self.job}", *(m.name.split("/")[0] for m in messages if m is not None and m.name)}:
            if system.get_file_info(f"{root}/{pending}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/{pending}")

    def commit(self, messages: list, batch: int | None = None) -> None:
        if self.overwrite and batch is None:
            system, _ = _files(self.path)
            for _, name, _ in _listed(self.path):
                system.delete_file(name)
        self._settle(messages, f"part-{self.job}" if batch is None else f"batch-{batch:09d}", None if batch is None else f"{batch:09d}")

    def abort(self, messages: list, batch: int | None = None) -> None:
        system, root = _files(self.path)
        for name in sorted({m.name for m in messages if m is not None and m.name}):
            system.delete_file(f"{root}/{name}")
        self._settle([], "", None)


class FrameSource(DataSource):
    """Options: path, maxFrameBytes, splitBytes. Rows: path, pos (byte), frame, error. As a sink it takes rows of any columns, or of one column frame, whose values are written as they are."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "path string, pos bigint, frame string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FrameWriter(self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return FrameWriter(self.options["path"])


def requests_of(read: DataFrame) -> DataFrame:
    """The rows of frames as requests: what parse_requests makes of a frame, and a request with an error of one that was too large."""
    from .requests import parse_requests

    whole = parse_requests(read.where("error IS NULL").select("path", "pos", F.col("frame").alias("value")))
    large = read.where("error IS NOT NULL").select("path", "pos", F.lit(None).cast("bigint").alias("id"), *(F.lit(None).cast("string").alias(c) for c in ("op", "text", "query")), F.lit(False).alias("ok"), "error")
    return whole.unionByName(large)
