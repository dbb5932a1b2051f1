"""Text files that grow, as a stream of lines: offsets are bytes of files, partitions are ranges of bytes."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "run_id string, seq long, value string"
#: Bytes that one task reads, and that are read from a file at a time.
PART_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: A file that hasn't changed for so many seconds is read to its end, even if its last line has no line break.
SETTLED_S = 10.0


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file, `end` lying at or before the end of its last whole line."""

    path: str
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def line_end(files: fs.FileSystem, path: str, size: int, from_: int) -> int:
    """Where the last whole line ends that ends after `from_`, or `from_`."""
    with files.open_input_file(path) as f:
        while size > from_:
            start = max(from_, size - READ_BYTES)
            at = f.read_at(size - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
    return from_


class LinesReader(DataSourceStreamReader):
    """Files are admitted in order of their names; a batch takes at most `maxBytes` new bytes.

    Spark asks for the newest offset before it says where a query stands, so what has been planned is noted in the file
    `progress`, which belongs into the query's checkpoint folder: a batch is planned again before anything newer is asked for.
    Without it the first batch after a start takes all there is, in ranges of bounded size.
    """

    def __init__(self, options: dict):
        self.path, self.part, self.progress = options["path"], int(options.get("partBytes", PART_BYTES)), options.get("progress")
        self.most, self.settled = int(options["maxBytes"]) if "maxBytes" in options else None, float(options.get("settledSeconds", SETTLED_S))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def _noted(self) -> dict | None:
        if self.progress is None:
            return None
        files, path = opened(self.progress)
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _note(self, end: dict) -> None:
        self.at = dict(end)
        if self.progress is not None:
            files, path = opened(self.progress)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            with files.open_output_stream(path + ".new") as f:
                f.write(json.dumps(end).encode())
            files.move(path + ".new", path)

    def latestOffset(self) -> dict:
        files, root = opened(self.path)
        self.at = self._noted() if self.at is None else self.at
        left = self.most if self.at is not None else None
        end = dict(self.at or {})
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in sorted((x for x in found if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            was = end.get(info.path, 0)
            if info.size <= was or left == 0:
                continue
            settled = info.mtime_ns is not None and time.time() - info.mtime_ns / 1e9 > self.settled
            to = info.size if settled else line_end(files, info.path, info.size, was)
            to = to if left is None else min(to, was + left)
            if to > was:
                end[info.path] = to
                left = None if left is None else left - (to - was)
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._note(end)
        ranges = [(p, start.get(p, 0), to) for p, to in sorted(end.items())]
        return [Range(p, a, min(a + self.part, to)) for p, was, to in ranges for a in range(was, to, self.part)]

    def read(self, partition: Range):
        files = opened(self.path)[0]
        with files.open_input_file(partition.path) as f:
            size, at = f.size(), partition.start
            # A range that begins inside a line leaves it to the range before.
            held, skip = b"", at > 0 and f.read_at(1, at - 1) != b"\n"
            begin = at
            while begin < partition.end:
                data = f.read_at(min(READ_BYTES, size - at), at) if at < size else b""
                at += len(data)
                *lines, held = (held + data).split(b"\n")
                if not data and held:
                    lines, held = [held], b""
                places, texts = [], []
                for line in lines:
                    if begin >= partition.end:
                        break
                    if skip:
                        skip = False
                    else:
                        places.append(begin)
                        texts.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                    begin += len(line) + 1
                if places:
                    yield pa.RecordBatch.from_pydict({"run_id": [partition.path] * len(places), "seq": places, "value": texts})
                if not data:
                    return


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LinesReader:
        return LinesReader(self.options)


def lines_stream(spark: SparkSession, folder: str, max_bytes: int | None = None, progress: str | None = None, **options) -> DataFrame:
    """run_id (the file), seq (the place of the line's first byte), value, as lines appear in the folder's files.

    max_bytes bounds a batch, from the first one on if progress names a file in the query's checkpoint folder.
    """
    spark.dataSource.register(Lines)
    options |= {k: v for k, v in {"maxBytes": max_bytes, "progress": progress}.items() if v is not None}
    return spark.readStream.format(Lines.name()).options(**{k: str(v) for k, v in options.items()}).load(folder)
