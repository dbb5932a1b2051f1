"""Files of lines, one for each run, on a local or mounted file system."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PENDING = "_temporary"


def local_path(df: DataFrame, path: str) -> str | None:
    """The path in the local file system, or None if it lies in another one."""
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    return files.makeQualified(where).toUri().getPath() if files.getUri().getScheme() == "file" else None


def folder_name(run: str | None) -> str:
    """The folder of a run, as Spark names and reads those of a partition column."""
    return "run_id=" + (re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda c: f"%{ord(c[0]):02X}", run) if run else "__HIVE_DEFAULT_PARTITION__")


@dataclass
class Written(WriterCommitMessage):
    folder: str


class RunFilesWriter(DataSourceArrowWriter):
    """Rows run_id, value in order of run_id -> a folder run_id=... with one file for each run of a task. A task writes into a
    folder of its own; those of the tasks that count are moved into place when all are done."""

    def __init__(self, options: dict):
        self.path, self.head = options["path"], options.get("head", "").encode()

    def write(self, iterator) -> Written:
        name = uuid.uuid4().hex
        folder, out, last = f"{self.path}/{PENDING}/{name}", None, None
        os.makedirs(folder)
        try:
            for batch in iterator:
                runs = pc.run_end_encode(batch.column("run_id"))
                values, start = batch.column("value").cast(pa.binary()), 0
                for run, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if out is None or run != last:
                        if out is not None:
                            out.close()
                        os.makedirs(f"{folder}/{folder_name(run)}", exist_ok=True)
                        out, last = open(f"{folder}/{folder_name(run)}/part-{name}-{run is None:d}.txt", "xb"), run  # noqa: SIM115
                        out.write(self.head)
                    out.write(b"\n".join(values.slice(start, end - start).to_pylist()) + b"\n")
                    start = end
        finally:
            if out is not None:
                out.close()
        return Written(folder)

    def commit(self, messages: list) -> None:
        placed = set()
        for folder in (m.folder for m in messages if m is not None):
            for run in sorted(os.listdir(folder)):
                if run not in placed:
                    os.rename(f"{folder}/{run}", f"{self.path}/{run}")
                else:
                    for file in os.listdir(f"{folder}/{run}"):
                        os.rename(f"{folder}/{run}/{file}", f"{self.path}/{run}/{file}")
                placed.add(run)
        shutil.rmtree(f"{self.path}/{PENDING}", ignore_errors=True)
        open(f"{self.path}/_SUCCESS", "wb").close()

    def abort(self, messages: list) -> None:
        shutil.rmtree(f"{self.path}/{PENDING}", ignore_errors=True)


class RunFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return "run_id string, value string"

    def writer(self, schema, overwrite: bool) -> RunFilesWriter:
        return RunFilesWriter(self.options)


def write(lines: DataFrame, path: str, head: list[str]) -> None:
    """lines(run_id, value), each run in one task and in order there, as files that begin with head. The folder must be new."""
    if os.path.exists(path):
        raise FileExistsError(path)
    os.makedirs(path)
    lines.sparkSession.dataSource.register(RunFiles)
    lines.select("run_id", "value").write.format(RunFiles.name()).mode("append").option("head", "".join(f"{x}\n" for x in head)).save(path)
