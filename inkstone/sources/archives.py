"""Members of zip archives as rows.

Archives come from `spark.read.format("binaryFile")`, so they may be in any store that Spark reads; a task unpacks the files
that it has read, member by member. What can't be read is a row with an error, and the job goes on.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MEMBERS = "path string, ordinal int, member string, content binary, error string"


def _row(path: str | None, ordinal: int | None, member: str | None, content: bytes | None, error: Exception | None) -> pa.RecordBatch:
    told = None if error is None else f"{type(error).__name__}: {error}"
    kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
    names = [f.split()[0] for f in MEMBERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, ordinal, member, content, told), kinds, strict=True)], names)


def archive_members(files: DataFrame, names: str = "") -> DataFrame:
    """(path, ordinal, member, content, error) of each member of `files` (path, content) in the archive's order.

    `names`: a pattern that is looked for in a member's name; others come without content. Folders are left out. A file that
    isn't an archive is one row with an error and no member, and so is a null content; a member that can't be unpacked
    keeps its row, with an error. One member at a time is in memory.
    """
    wanted = re.compile(names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                content = batch.column("content")[k].as_buffer()
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except Exception as e:  # noqa: BLE001 - a bad file must not end the job
                    yield _row(path, None, None, None, e)
                    continue
                with archive:
                    for ordinal, info in enumerate(i for i in archive.infolist() if not i.is_dir()):
                        data = error = None
                        if wanted.search(info.filename):
                            try:
                                data = archive.read(info)
                            except Exception as e:  # noqa: BLE001
                                error = e
                        yield _row(path, ordinal, info.filename, data, error)

    return files.select("path", "content").mapInArrow(unpack, MEMBERS)


def pack_archives(rows: DataFrame) -> DataFrame:
    """(path, content) of archives from rows (path, members array<struct<member, content>>), in the order of the array. A member
    `mimetype` is stored as it is, others are deflated; all have one date, so that equal rows give equal bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                body = io.BytesIO()
                with zipfile.ZipFile(body, "w") as file:
                    for m in batch.column("members")[k].as_py() or []:
                        way = zipfile.ZIP_STORED if m["member"] == "mimetype" else zipfile.ZIP_DEFLATED
                        file.writestr(zipfile.ZipInfo(m["member"]), m["content"] or b"", way)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([body.getvalue()], pa.binary())], ["path", "content"])

    return rows.select("path", "members").mapInArrow(pack, "path string, content binary")
