"""A sink of named text files: many documents a task, one file each, and a commit that shows all of them or none.

``df.write.format("named_files")`` takes rows (name, line_no, line). Each task writes the files of its documents into a folder of its own
attempt; the commit moves each of these folders into place, so the driver handles one path a task and no file's name. Files lie under
``part-00000/``, ``part-00001/``, ... and never change once they show. Lines end as in CSV (CRLF), behind a byte-order mark.
Paths may be local or anything else that Arrow's file systems open.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "named_files"
BOM, LINE_END = "﻿", "\r\n"


@dataclass
class Attempt(WriterCommitMessage):
    task: int
    folder: str


def file_name(name: str, ending: str) -> str:
    """A name that any file system takes: no separators or control characters, not too long, never empty; different names may become the same."""
    plain = re.sub(r'[\x00-\x1f\x7f/\\:*?"<>|]', "_", name).strip(" .")
    return (plain.encode()[:200].decode("utf-8", "ignore") or "_") + ending


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.ending = options["path"].rstrip("/").removeprefix("file:") if options["path"].startswith("file:/") and "://" not in options["path"] else options["path"].rstrip("/"), options.get("ending", ".csv")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Attempt:
        """The files of one task. Rows come sorted by name and line; a name that was used before in this task gets a number."""
        task = TaskContext.get()
        system, root = _open(self.path)
        folder = f"_temporary/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        used: dict[str, int] = {}
        name, out = None, None
        try:
            for batch in iterator:
                for own, line in zip(batch.column("name").to_pylist(), batch.column("line").to_pylist()):
                    if out is None or own != name:
                        if out is not None:
                            out.close()
                        else:
                            system.create_dir(f"{root}/{folder}", recursive=True)
                        name, plain = own, file_name("" if own is None else own, "")
                        used[plain] = used.get(plain, 0) + 1
                        out = system.open_output_stream(f"{root}/{folder}/{plain}{f' ({used[plain]})' if used[plain] > 1 else ''}{self.ending}")
                        out.write(BOM.encode())
                    out.write(((line or "") + LINE_END).encode())
        finally:
            if out is not None:
                out.close()
        return Attempt(task.partitionId(), folder if name is not None or out is not None else "")

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        shown = [x for x in system.get_file_info(fs.FileSelector(root)) if re.fullmatch(r"part-\d+", x.base_name)]
        if self.overwrite:
            for old in shown:
                system.delete_dir(old.path)
        first = 0 if self.overwrite else 1 + max((int(x.base_name[5:]) for x in shown), default=-1)
        for message in messages:
            if message is not None and message.folder:
                system.move(f"{root}/{message.folder}", f"{root}/part-{first + message.task:05d}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _open(self.path)
        try:
            system.delete_dir(f"{root}/_temporary/{self.job}")
        except OSError:
            pass  # no task wrote anything


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, line_no int, line string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def write_files(lines: DataFrame, path: str, key: str = "doc_id", mode: str = "overwrite", ending: str = ".csv") -> None:
    """Write (key, line_no, line) as one file for each key, named after it. Null keys share one file; an empty table leaves an empty folder."""
    register(lines.sparkSession)
    rows = lines.select(F.col(f"`{key}`").cast("string").alias("name"), F.col("line_no").cast("int").alias("line_no"), "line")
    rows.repartition("name").sortWithinPartitions("name", "line_no").write.format(FORMAT).option("path", path).option("ending", ending).mode(mode).save()
