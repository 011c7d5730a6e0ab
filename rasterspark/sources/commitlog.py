"""A manifest as a log of commits: immutable data files and numbered snapshots.

``data/<uuid>`` holds the rows that one append brought, ``log/<number>.json``
names the data of each commit.  A commit's file is put only where no other has
its number, so of two writers one commits and the other judges its rows again,
against what the first has added.  Nothing is overwritten: what can't be read is
an error, and the snapshots before it stay as they are.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    """(path, its file system, settings) on the JVM's side."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(conf), conf


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole; False if the path is taken."""
    target, files, conf = _hadoop(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = files.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
        context.rename(part, target, spark.sparkContext._gateway.new_array(kind, 0))  # fails where the target exists
    except Py4JJavaError as error:
        files.delete(part, False)
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


class ManifestLog:
    """Rows with one key each, appended in commits."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def commits(self) -> list[dict]:
        """All commits in order: {version, data, n_rows}, one small row each."""
        log, files, _ = _hadoop(self.spark, f"{self.path}/log")
        if not files.exists(log) or not any(s.getPath().getName().endswith(".json") for s in files.listStatus(log)):
            return []
        found = sorted((json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/log/*.json", wholetext=True).collect()), key=lambda c: c["version"])
        if [c["version"] for c in found] != list(range(1, len(found) + 1)):
            raise ValueError(f"{self.path}: commits are missing")
        return found

    def snapshot(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the newest; None before the first commit."""
        held = [c for c in self.commits() if version is None or c["version"] <= version]
        return self._rows(held)

    def _rows(self, commits: list[dict]) -> DataFrame | None:
        data = [f"{self.path}/data/{c['data']}" for c in commits if c["n_rows"]]
        if not commits:
            return None
        return self.spark.read.parquet(*(data or [f"{self.path}/data/{commits[0]['data']}"]))

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name, self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}").count()

    def _commit(self, version: int, name: str, n_rows: int) -> bool:
        return put_if_absent(self.spark, f"{self.path}/log/{version:020d}.json", json.dumps({"version": version, "data": name, "n_rows": n_rows}))

    def append_new(self, rows: DataFrame) -> int:
        """Commit the rows whose key no snapshot has; returns how many it left out, as copies of each other or of the manifest."""
        held, given = self.commits(), rows.count()
        known, new = self._rows(held), rows.dropDuplicates([self.key])
        name, n_rows = self._write(new if known is None else new.join(known.select(self.key), self.key, "left_anti").select(*rows.columns))
        while not self._commit(len(held) + 1, name, n_rows):
            before, held = len(held), self.commits()
            own = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}")
            loser = name
            name, n_rows = self._write(own.join(self._rows(held[before:]).select(self.key), self.key, "left_anti").select(*rows.columns))
            stale, files, _ = _hadoop(self.spark, f"{self.path}/data/{loser}")
            files.delete(stale, True)
        return given - n_rows
