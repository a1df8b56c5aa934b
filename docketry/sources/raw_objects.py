"""Scan of raw uploaded files laid out as ``<root>/<doc_id>/<filename>``."""

from __future__ import annotations

import fnmatch
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The classes travel to the executors by value; those need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC_BYTES = 4
# Entries of the root that one task lists and opens.
ENTRIES_IN_A_TASK = 1_000
# Schemes that Hadoop and Arrow name differently.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def file_system(root: str):
    """Arrow's file system for a path as Spark writes it, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = root.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), root
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, key = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{authority}/")
    return system, f"{base.rstrip('/')}/{key}"


def is_hidden(name: str) -> bool:
    """Files that Spark's own sources leave out, too."""
    return name.startswith((".", "_"))


class Entries(InputPartition):
    """Folders and files right below the root: (path, size, None for folders)."""

    def __init__(self, entries: list[tuple[str, int | None]]):
        self.entries = entries


class RawObjectsReader(DataSourceReader):
    def __init__(self, root: str, name_glob: str):
        self.root, self.name_glob = root, name_glob

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = file_system(self.root)
        found = system.get_file_info(fs.FileSelector(path))
        entries = sorted(
            (f.path, f.size if f.is_file else None) for f in found if not is_hidden(f.base_name)
        )
        cuts = range(0, len(entries), ENTRIES_IN_A_TASK)
        return [Entries(entries[i : i + ENTRIES_IN_A_TASK]) for i in cuts] or [Entries([])]

    def read(self, partition: Entries) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = file_system(self.root)
        for entry, size in partition.entries:
            if size is not None:
                files = [(entry, size)]
            else:
                below = system.get_file_info(fs.FileSelector(entry, recursive=True))
                files = sorted((f.path, f.size) for f in below if f.is_file)
            for path, length in files:
                inside = path[len(root) :].strip("/").split("/")
                if any(map(is_hidden, inside)) or not fnmatch.fnmatchcase(inside[-1], self.name_glob):
                    continue
                with system.open_input_file(path) as file:
                    magic = file.read_at(min(MAGIC_BYTES, length), 0) if length else b""
                parent = inside[-2] if len(inside) > 1 else root.rstrip("/").rpartition("/")[2]
                yield parent, inside[-1], length, magic


class RawObjects(DataSource):
    """``spark.read.format("raw_objects").option("name_glob", "*.pdf").load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "raw_objects"

    def schema(self) -> str:
        return "doc_id string, filename string, size_bytes long, magic binary"

    def reader(self, schema) -> DataSourceReader:
        return RawObjectsReader(self.options["path"], self.options.get("name_glob", "*"))


def scan_raw_documents(
    spark: SparkSession, root: str, name_glob: str = "*", ranged: bool = True
) -> DataFrame:
    """doc_id, filename, size_bytes and the first four bytes of every file.

    The driver lists the entries right below ``root``; tasks list what is below
    those, 1,000 to a task, open each file and read four bytes at its start,
    whatever its length. An empty file has a row with empty ``magic``, a file that
    is gone since it was listed fails its task, names with a leading dot or
    underscore are left out. Any storage Arrow opens will do (local, HDFS, S3, GCS,
    Azure); a path without a scheme is in ``spark.hadoop.fs.defaultFS`` if that is set.

    ``ranged=False`` is for storage that only Spark opens: there a file's first
    bytes come with its content, read whole; a file above
    ``spark.sql.sources.binaryFile.maxLength`` (2 GB) fails, an empty one has no row.
    """
    if ranged:
        default = spark.conf.get("spark.hadoop.fs.defaultFS", None)
        if default and root.startswith("/"):
            root = default.rstrip("/") + root
        spark.dataSource.register(RawObjects)
        return spark.read.format("raw_objects").option("name_glob", name_glob).load(root)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", name_glob)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("doc_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.substring("content", 1, MAGIC_BYTES).alias("magic"),
    )
