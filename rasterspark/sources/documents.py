"""One JSON document out of many tasks.

A document {version, entry_count, entries} is a folder whose files, one behind
another in the order of their names, are its text: ``0-head.json``, a part for
each task with a separator behind it, and ``2-tail.json``.  Tasks write their
parts, one entry a line; the commit names the parts of the attempts that count,
and knows the number of entries from them.  No row leaves its task.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    """What a task has written."""

    task: int
    name: str
    n_rows: int


def file_system(path: str):
    """(file system, path within it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


class DocumentWriter(DataSourceWriter):
    """Parts by tasks; head, separators and tail by the commit."""

    def __init__(self, path: str, version: str):
        self.path, self.version = path.rstrip("/"), version

    def write(self, rows) -> Part:
        from pyspark import TaskContext

        files, path = file_system(self.path)
        files.create_dir(path, recursive=True)
        name, n = f".{uuid.uuid4().hex}", 0
        with files.open_output_stream(f"{path}/{name}") as out:
            for row in rows:
                out.write(("," * bool(n) + row[0] + "\n").encode())
                n += 1
        return Part(TaskContext.get().partitionId(), name, n)

    def commit(self, messages) -> None:
        files, path = file_system(self.path)
        parts = sorted((m for m in messages if m), key=lambda m: m.task)
        full = [m for m in parts if m.n_rows]
        for k, m in enumerate(full):
            files.move(f"{path}/{m.name}", f"{path}/1-{k:06d}.json")
            if k + 1 < len(full):
                self._put(files, f"{path}/1-{k:06d}.sep", ",\n")
        for m in parts:
            if not m.n_rows:
                files.delete_file(f"{path}/{m.name}")
        files.create_dir(path, recursive=True)
        self._put(files, f"{path}/2-tail.json", "]}\n")
        self._put(files, f"{path}/0-head.json", f'{{"version": {json.dumps(self.version)}, "entry_count": {sum(m.n_rows for m in full)}, "entries": [\n')

    def abort(self, messages) -> None:
        files, path = file_system(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{path}/{m.name}")

    @staticmethod
    def _put(files, path: str, text: str) -> None:
        with files.open_output_stream(path) as out:
            out.write(text.encode())


class JsonDocument(DataSource):
    """The writer, under the name ``json_document``: one column of JSON text; options ``path`` and ``version``."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if overwrite:
            raise ValueError("a document is written once, to a new path")
        return DocumentWriter(self.options["path"], self.options.get("version", "1.0"))


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(own)


def is_document(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a committed document."""
    return _exists(spark, f"{path.rstrip('/')}/0-head.json")


def write(rows: DataFrame, path: str, version: str = "1.0") -> None:
    """Write ``rows`` as one document in a new folder."""
    spark = rows.sparkSession
    if _exists(spark, path):
        raise ValueError(f"{path} is there already")
    spark.dataSource.register(JsonDocument)
    rows.select(F.to_json(F.struct("*")).alias("value")).write.format("json_document").mode("append").option("version", version).save(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The entries, read by as many tasks as there are parts."""
    lines = spark.read.schema("value string").text(path, pathGlobFilter="1-*.json")
    return lines.select(F.from_json(F.ltrim(F.col("value"), F.lit(",")), schema).alias("entry")).select("entry.*")


def head(spark: SparkSession, path: str) -> dict:
    """{version, entry_count}; an error where the document has no head, so was not committed."""
    line = spark.read.text(f"{path.rstrip('/')}/0-head.json").first()[0]
    told = json.loads(line + "]}")
    return {k: told[k] for k in ("version", "entry_count")}
