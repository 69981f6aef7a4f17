"""Files as rows and rows as files.

``scan`` turns every file under a path into rows by a parser of bytes; Spark lists and reads the files, so any file
system it knows will do, and reads no file whose path a filter rules out; a parser makes all its columns.  ``MediaFiles`` is a sink that writes one file per row.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema


def scan(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[dict]], schema: str, mode: str = "PERMISSIVE", glob: str | None = None) -> DataFrame:
    """``path``, ``status`` and the fields of ``schema`` for each row that ``parse`` finds in a file.

    A file that can't be parsed gives one row with its error as status, or ends the job if ``mode`` is FAILFAST.
    """
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    fields = T.StructType([T.StructField("path", T.StringType()), T.StructField("status", T.StringType()), *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [{"path": path, "status": "OK", **r} for r in parse(content.as_py())]
                except (ValueError, LookupError, ArithmeticError, struct.error) as e:  # what parsers of bytes raise on broken ones
                    if mode == "FAILFAST":
                        raise
                    rows = [{"path": path, "status": str(e)}]
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 1000], schema=arrow)

    return files.mapInArrow(run, fields)


def numbered(files: DataFrame, pattern: str = r"(\d+)\.[^./]*$", column: str = "path") -> DataFrame:
    """Files of a numbered sequence with their number; others are left out."""
    from pyspark.sql import functions as F

    number = F.try_to_number(F.regexp_extract(column, pattern, 1), F.lit("999999999999")).cast("long")
    return files.withColumn("number", number).where("number is not null")


class _Done(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = self._place()
        pending = f"{root}/_pending/{uuid.uuid4().hex}"
        system.create_dir(pending, recursive=True)
        names = []
        for k, row in enumerate(iterator):
            if "/" in row.name or row.name.startswith((".", "_")):
                raise ValueError(f"{row.name!r} is no name for a file")
            with system.open_output_stream(f"{pending}/{k}") as f:
                f.write(bytes(row.content))
            names.append((f"{pending}/{k}", row.name))
        return _Done(names)

    def commit(self, messages) -> None:
        system, root = self._place()
        for m in messages:
            for source, name in m.names if m else ():
                system.move(source, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, root = self._place()
        from pyarrow import fs

        if system.get_file_info(f"{root}/_pending").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_pending")


class MediaFiles(DataSource):
    """Sink ``media_files``: rows (name, content) as files of a folder, visible once all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    from ..streaming.tail import GrowingKlv

    for source in (MediaFiles, GrowingKlv):
        spark.dataSource.register(source)
