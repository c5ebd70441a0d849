"""Rows (name, data) written as files, one a row: a data source with commit and abort.

A task writes its files into a folder of its own attempt below the target, with a list of their names. Only when all tasks
have ended, the files of the attempts that count are moved to their names, which happens in the driver, a few at once and
without any file's content; so a task that is killed, repeated or run twice leaves no file and no half of one, and a job
that fails leaves the target as it was. The names come from the lists in the store, one list at a time.

The target is a folder in a store that the driver and all executors reach: a path, or a URI that pyarrow knows.
Rows whose data is null make no file. A file that was there before is replaced. Names may have folders in them, but
may not lead out of the target; a null name, or one name for two rows, is an error.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Files that are moved at once by the driver.
MOVERS = 16
#: Written last, as Spark's own writers do.
DONE = "_SUCCESS"


def checked_name(name: str | None) -> str:
    """A name below the target, or a ValueError."""
    steps = (name or "").split("/")
    if any(s in ("", ".", "..") for s in steps) or "\0" in (name or "") or steps[0].startswith("_files-"):
        raise ValueError(f"not a name of a file: {name!r}")
    return "/".join(steps)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt, below the target."""

    folder: str


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path
        self.job = f"_files-{uuid.uuid4().hex}"
        # Only here: a task that outlives its job finds no folder to write into.
        store, root = _store(path)
        store.create_dir(f"{root}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.path)
        folder = f"{self.job}/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{folder}", recursive=False)
        with store.open_output_stream(f"{root}/{folder}/names") as names:
            k = 0
            for row in iterator:
                if row["data"] is None:
                    continue
                names.write((json.dumps(checked_name(row["name"])) + "\n").encode())
                with store.open_output_stream(f"{root}/{folder}/{k}") as out:
                    out.write(bytes(row["data"]))
                k += 1
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)

        def move(job: tuple[str, str]) -> None:
            source, name = job
            store.create_dir(os.path.dirname(f"{root}/{name}"), recursive=True)
            store.move(source, f"{root}/{name}")

        with ThreadPoolExecutor(MOVERS) as movers:
            for message in messages:
                if message is None:
                    continue
                with store.open_input_stream(f"{root}/{message.folder}/names") as names:
                    moves = [(f"{root}/{message.folder}/{k}", json.loads(line)) for k, line in enumerate(names.read().splitlines())]
                for _ in movers.map(move, moves):
                    pass
        self.abort(messages)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{DONE}"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what all attempts of the job have left; those that still run may write while that goes on."""
        store, root = _store(self.path)
        for last in [False] * 20 + [True]:
            try:
                if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
                    store.delete_dir(f"{root}/{self.job}")
                return
            except OSError:
                if last:
                    raise
                time.sleep(0.1)


class Files(DataSource):
    """`df.write.format("inkstone_files").mode("append").save(path)`, of columns name (string) and data (binary)."""

    @classmethod
    def name(cls) -> str:
        return "inkstone_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        types = {f.name: f.dataType.simpleString() for f in schema.fields}
        if types != {"name": "string", "data": "binary"}:
            raise ValueError(f"columns name (string) and data (binary) expected, not {types}")
        if overwrite:
            raise ValueError("files are put into a folder one by one: append expected")
        return FilesWriter(self.options["path"])


def write_files(rows: DataFrame, path: str, name: str = "name", data: str = "data") -> None:
    """Writes a file for each row whose data isn't null. Other columns don't matter.

    Names are counted before, without the data, so that no file takes another's place unseen.
    """
    twice = [r["name"] for r in rows.groupBy(F.col(name).alias("name")).count().where("name IS NOT NULL AND count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"several rows have one name, as {', '.join(twice)}")
    rows.sparkSession.dataSource.register(Files)
    out = rows.select(F.col(name).cast("string").alias("name"), F.col(data).cast("binary").alias("data"))
    out.write.format(Files.name()).mode("append").save(path)
