"""What lies in a folder, against what should lie there."""

from __future__ import annotations

import fnmatch
import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import file_system
from .manifests import kept


#: Rows that list a folder's entries, and files that a task holds at a time.
LISTED, ENTRIES = "path string, length long, is_folder boolean", 64


def _dealt(rows: DataFrame) -> DataFrame:
    """As many tasks as a shuffle has, however few bytes the rows are: each stands for a file or a folder."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path"))


def write_each(rows: DataFrame, folder: str) -> int:
    """A file for each row of (path, value), ``path`` below ``folder`` and ``value`` text or bytes; how many were written.

    Tasks put files in place themselves, under another name until they are whole,
    so the driver has nothing to move; a task that runs twice writes the same.
    """
    def run(batches):
        files, top = file_system(folder)
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                own = f"{top}/{path}".rpartition("/")
                files.create_dir(own[0], recursive=True)
                with files.open_output_stream(f"{own[0]}/.{(name := uuid.uuid4().hex)}") as out:
                    out.write(value)
                files.move(f"{own[0]}/.{name}", "".join(own))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return _dealt(rows.select("path", F.col("value").cast("binary").alias("value"))).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _entries(folders: DataFrame, folder: str) -> DataFrame:
    """What lies directly in each folder of ``folders`` (path, within the file system of ``folder``); hidden names are left out as Spark does."""
    def run(batches):
        from pyarrow import fs

        files, _ = file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = [x for x in files.get_file_info(fs.FileSelector(path)) if not (x.base_name[0] == "." or x.base_name[0] == "_" and "=" not in x.base_name or x.base_name.endswith("._COPYING_"))]
                yield pa.RecordBatch.from_pydict({"path": pa.array([x.path for x in found], pa.string()), "length": pa.array([x.size or 0 for x in found], pa.int64()), "is_folder": pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_())})

    return folders.mapInArrow(run, LISTED)


def _qualified(spark: SparkSession, folder: str) -> str:
    """The URI of a folder, as Spark would find it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def _names(pattern: str) -> list[str]:
    """Regular expressions of a pattern of names (* ? [a-z] [^a-z] {a,b})."""
    if found := re.search(r"\{([^{}]*)\}", pattern):
        return [n for part in found[1].split(",") for n in _names(pattern[: found.start()] + part + pattern[found.end() :])]
    return [f"^{fnmatch.translate(pattern.replace('[^', '[!'))[:-2]}\\z"]


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of every file below a folder whose name fits ``pattern``, empty ones too; contents are not read.

    Folders are listed by tasks, one level of the tree after another; neither names nor sizes pass the driver.
    """
    uri = _qualified(spark, folder)
    top = file_system(uri)[1]
    level, levels = spark.createDataFrame([(top,)], "path string"), []
    while not levels or not level.isEmpty():
        found = kept(_entries(_dealt(level) if levels else level, uri), "listing")
        levels.append(found.where("NOT is_folder").select("path", "length"))
        level = found.where("is_folder").select("path")
    fits = reduce(Column.__or__, [F.element_at(F.split("path", "/"), -1).rlike(n) for n in _names(pattern)])
    return reduce(DataFrame.unionByName, levels).where(fits).select(F.concat(F.lit(uri[: uri.rindex(top)]), "path").alias("path"), "length")


def contents(found: DataFrame, n_bytes: int | None = None) -> DataFrame:
    """``found`` (path, length) of a listing plus ``content``: the bytes of each file, the first ``n_bytes`` of them if given."""
    def run(batches):
        files = None
        for batch in batches:
            for low in range(0, batch.num_rows, ENTRIES):
                some, read = batch.slice(low, ENTRIES), []
                for path in some.column("path").to_pylist():
                    if files is None:  # all files of a listing lie in one file system
                        files, own = file_system(path)
                        n_before = len(path) - len(own)
                    with files.open_input_file(path[n_before:]) as own:
                        read.append(own.read(n_bytes))
                yield pa.RecordBatch.from_arrays([some.column("path"), some.column("length"), pa.array(read, pa.binary())], ["path", "length", "content"])

    return _dealt(found.select("path", "length")).mapInArrow(run, "path string, length long, content binary")


def headers(spark: SparkSession, folder: str, pattern: str = "*", n_bytes: int = 16, most: int = 64 << 20) -> DataFrame:
    """(path, length, head) with the first bytes of the files of at most ``most`` bytes; NULL for larger and empty ones, which are not read."""
    found = listing(spark, folder, pattern)
    read = f"length > 0 AND length <= {most}"
    small = contents(found.where(read), n_bytes).withColumnRenamed("content", "head")
    return small.unionByName(found.where(f"NOT ({read})").select("path", "length", F.lit(None).cast("binary").alias("head")))


def name_of(path: Column, depth: int = 1) -> Column:
    """The last ``depth`` parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), -depth, depth), "/")


def file_issues(found: DataFrame, expected: DataFrame, key: str = "name", least: int = 1) -> DataFrame:
    """(key, issue): expected files that are missing, empty or shorter than ``least`` bytes (or than their own ``least`` column), and files that nothing expects.

    ``found`` has (key, length), and ``head`` where ``expected`` has one to begin with.
    """
    wanted = expected.select(key, (F.col("least") if "least" in expected.columns else F.lit(least)).alias("_least"), (F.col("head") if "head" in expected.columns else F.lit(None).cast("binary")).alias("_head"), F.lit(True).alias("_wanted"))
    have = found.select(key, "length", (F.col("head") if "head" in found.columns else F.lit(None).cast("binary")).alias("_own"), F.lit(True).alias("_there"))
    both = wanted.join(have, key, "full")
    other = F.col("_head").isNotNull() & F.col("_own").isNotNull() & ~F.startswith("_own", "_head")
    issue = F.when(F.col("_there").isNull(), "missing").when(F.col("_wanted").isNull(), "unexpected").when(F.col("length") == 0, "empty").when(F.col("length") < F.col("_least"), "short").when(other, "other kind")
    return both.select(key, issue.alias("issue")).where("issue IS NOT NULL")
