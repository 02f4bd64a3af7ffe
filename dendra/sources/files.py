"""A sink of named files, one per key, committed once: Spark's data source interface for what its text writer can't name.

Tasks write each file under its final name in a job's own folder beside the target, through a name of their attempt that is renamed when the file is whole. Their
messages list what they wrote; the driver checks that no name came from two tasks and moves the job's folder to its place in one step. A job that fails
leaves nothing: its folder is deleted. Any file system that pyarrow opens will do (local and mounted folders, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "dendra_files"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path``, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether tasks can open ``path``."""
    try:
        opened(path)
    except (pa.ArrowInvalid, OSError, ValueError, ImportError):
        return False
    return True


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class NamedFiles(DataSource):
    """Rows (name string, data string or binary): a file per name, its rows' data one after the other. A name's rows come in one task, together."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema.fields] != ["name", "data"]:
            raise ValueError(f"columns name and data are written, not {[f.name for f in schema.fields]}")
        return NamedFilesWriter(self.options["path"].rstrip("/"), overwrite)


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        head, _, last = path.rpartition("/")
        self.path, self.overwrite, self.job = path, overwrite, f"{head}/.{last}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, job = opened(self.job)
        attempt, names, stream = uuid.uuid4().hex[:12], [], None

        def close() -> None:
            if stream is not None:
                stream.close()
                fs.move(f"{job}/.{attempt}", f"{job}/{names[-1]}")

        for batch in iterator:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not names or name != names[-1]:
                    close()
                    if not name or "/" in name or ":" in name or name.startswith("."):
                        raise ValueError(f"{name!r} is no file name")
                    if not names:
                        fs.create_dir(job)
                    names.append(name)
                    stream = fs.open_output_stream(f"{job}/.{attempt}")
                stream.write(data.as_buffer())
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, job = opened(self.job)
        path = opened(self.path)[1]
        twice = [n for n, c in Counter(n for m in messages if m for n in m.names).items() if c > 1]
        if twice:
            fs.delete_dir(job)
            raise ValueError(f"rows of one name came in several tasks: {twice[:3]}")
        fs.create_dir(job)  # there may be no rows
        if self.overwrite and fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)
        for leftover in fs.get_file_info(pafs.FileSelector(job)):  # of attempts that lost
            if leftover.base_name.startswith("."):
                fs.delete_file(leftover.path)
        fs.move(job, path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, job = opened(self.job)
        if fs.get_file_info(job).type != pafs.FileType.NotFound:
            fs.delete_dir(job)


def write_files(rows: DataFrame, path: str, mode: str = "error", order: str | None = None) -> None:
    """Files of ``rows`` (name, data, and a column to sort a name's rows by) in the folder ``path``. mode: error or overwrite."""
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode {mode}")
    fs, there = opened(path)
    if mode == "error" and fs.get_file_info(there).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    rows.sparkSession.dataSource.register(NamedFiles)
    dealt = rows.repartition("name").sortWithinPartitions("name", *([order] if order else [])).select("name", "data")
    dealt.write.format(FORMAT).mode("append" if mode == "error" else "overwrite").option("path", path).save()
