"""Small files in any store that Arrow reaches by URI (local, HDFS, object stores): pages of feeds, manifests, workbooks."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a URI, or of a local path; blanks and the like needn't be escaped."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + re.sub("^file:/*", "", uri)
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(quote(uri, safe="/:@?&=+,;$!~*'()%"))


def names(uri: str) -> list[str]:
    """What lies directly below a folder, in order; nothing where there is none."""
    fs, path = opened(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(os.path.basename(f.path) for f in found)


def exists(uri: str) -> bool:
    fs, path = opened(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def read(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def write(uri: str, body: bytes) -> None:
    """The file whole or not at all: written beside its place, then moved there."""
    fs, path = opened(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    beside = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as f:
        f.write(body)
    fs.move(beside, path)


def delete(uri: str) -> None:
    """Gone afterwards, also if it wasn't there."""
    fs, path = opened(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)


def write_files(files: DataFrame, top: str, name: str = "name", body: str = "body") -> int:
    """A file below `top` for every row (name, body as text or bytes), written by the executors; the number of files.

    A task that runs again writes the same files over. Names with folders in them make these. Rows with a null name are
    left out; a null body is an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                write(f"{top}/{at}", content or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = files.filter(F.col(name).isNotNull()).select(name, F.col(body).cast("binary").alias("body"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
