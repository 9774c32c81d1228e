"""Files of an archive, listed, read, stored and deleted by tasks through the path's own file system."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import stored_copy

# Opens a path of a scheme: the file system and the path inside of it. Schemes that Arrow knows need none.
Opener = Callable[[str], tuple[fs.FileSystem, str]]
Schemes = Mapping[str, Opener]


def open_path(path: str, schemes: Schemes | None = None) -> tuple[fs.FileSystem, str]:
    """The file system of a path, plain or with a scheme; an unknown scheme is an OSError."""
    scheme, colon, rest = path.partition(":")
    if schemes and colon and scheme in schemes:
        return schemes[scheme](path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(path)
    except (ValueError, pa.ArrowException) as problem:
        raise OSError(f"no file system for {path}: {problem}") from problem


def read_file(path: str, schemes: Schemes | None = None) -> bytes | None:
    """Content of a file; nothing when it is gone."""
    system, inside = open_path(path, schemes)
    try:
        with system.open_input_stream(inside) as file:
            return file.read()
    except FileNotFoundError:
        return None


def store_file(path: str, content: bytes, schemes: Schemes | None = None) -> str | None:
    """Store a file whole or not at all, and never over another one: it is written under a name of its
    own and then moved. Returns nothing when the file is there with this content, else why it isn't."""
    system, inside = open_path(path, schemes)
    folder, _, name = inside.rpartition("/")
    staged = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if system.get_file_info(inside).type == fs.FileType.NotFound:
        with system.open_output_stream(staged) as out:
            out.write(content)
        # Another task may have been faster: what is there stays.
        if system.get_file_info(inside).type == fs.FileType.NotFound:
            system.move(staged, inside)
        else:
            system.delete_file(staged)
    return None if read_file(path, schemes) == content else "another file is there"


def delete_file(path: str, schemes: Schemes | None = None) -> None:
    """Delete a file; one that is gone already is fine. Anything else that keeps it there is an OSError."""
    system, inside = open_path(path, schemes)
    if system.get_file_info(inside).type != fs.FileType.NotFound:
        system.delete_file(inside)
    if system.get_file_info(inside).type != fs.FileType.NotFound:
        raise OSError(f"still there: {path}")


_LISTED = "path string, name string, length bigint, modified timestamp, folder boolean"


def list_files(spark: SparkSession, path: str, schemes: Schemes | None = None) -> DataFrame:
    """``(path, name, length, modified)`` of all files under a folder, listed by tasks: a round for each
    level, a task for each few folders of it. Hidden files are left out; a missing folder has no files."""
    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, inside = open_path(folder, schemes)
                found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
                found = [f for f in found if not f.base_name.startswith((".", "_"))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{folder.rstrip('/')}/{f.base_name}" for f in found], pa.string()), pa.array([f.base_name for f in found], pa.string()),
                    pa.array([None if f.type == fs.FileType.Directory else f.size for f in found], pa.int64()),
                    pa.array([f.mtime for f in found], pa.timestamp("us", "UTC")), pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_())],
                    ["path", "name", "length", "modified", "folder"])

    folders = spark.createDataFrame([(path,)], "path string")
    files = None
    while True:
        level = stored_copy(folders.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(listing, _LISTED), "listing")
        here = level.where(~F.col("folder"))
        files = here if files is None else files.unionByName(here)
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            return files.drop("folder")
