"""What several operators share: the shared folder, materialised steps, free column names, words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Where rows without an id sort: after every row that has one.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a local session has none (tests, a laptop), a temporary one is set; on
    a cluster that is an error, as executors would write to their own disks.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's folder within the shared one."""
    return f"{shared_dir(spark)}/rasterspark-llm-{spark.sparkContext.applicationId}"


def close(spark: SparkSession) -> None:
    """Delete every table that the operators of this application have kept; nothing may read one any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, **values):
    """The session with other values of some settings (``__`` stands for a dot)."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, batch: int = 2048) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not the steps before.
    Python steps get Arrow batches of ``batch`` rows, so that whole texts need
    little memory.  ``discard`` deletes the table when nothing reads it any more,
    ``close`` all tables of an application.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(batch)):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.shared_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``docs`` already has a column of that name."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(*names: str) -> list[str]:
    """Column names as references, whatever characters they hold."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def with_output(docs: DataFrame, out: dict) -> list:
    """The columns of ``docs`` plus those of ``out``, which replace columns of their names."""
    new = {name.lower() for name in out}
    return [*quoted(*(c for c in docs.columns if c.lower() not in new)), *(column.alias(name) for name, column in out.items())]


def lean(run):
    """A step over frames that gives the memory it has freed back to the system when a partition ends.

    Python workers live on between tasks; what the C library keeps for them
    would count against the executor all the while.
    """

    def lean_run(frames):
        yield from run(frames)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return lean_run


def whole_groups(frames, keys: list[str]):
    """Frames that hold whole groups only, from frames in which each group's rows are adjacent.

    No more than the open group and one frame is held.
    """
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        own = [frame[k].to_numpy() for k in keys]
        other = np.logical_or.reduce([c != c[-1] for c in own])
        last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # where the last group begins
        if held and (last or any(c[0] != held[-1][k].iat[0] for c, k in zip(own, keys, strict=True))):
            if not last:
                yield _joined(held)
                held = [frame]
                continue
            held.append(frame.iloc[:last])
            yield _joined(held)
            held = [frame.iloc[last:]]
        else:
            if last:
                yield frame.iloc[:last]
            held.append(frame.iloc[last:])
    if held:
        yield _joined(held)


def _joined(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return (frames[0] if len(frames) == 1 else pd.concat(frames)).reset_index(drop=True)


def in_slices(rows, columns: list[str], size, most: int = 1 << 22):
    """Frames of about ``most`` bytes out of tuples; ``size`` gives the bytes of one."""
    held, so_far = [], 0
    for row in rows:
        held.append(row)
        so_far += size(row)
        if so_far >= most:
            yield pd.DataFrame(held, columns=columns)
            held, so_far = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def n_words(text) -> F.col:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def random_table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class RangeHash:
    """64-bit hashes of ranges of a sequence of 64-bit units, any range in O(1)."""

    def __init__(self, units: np.ndarray, seed: int):
        base = int(random_table(seed, 1)[0])
        inverse = pow(base, -1, 1 << 64)
        n = len(units)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * powers[:n], out=self.sums[1:])
        powers[:] = inverse
        powers[0] = 1
        self.back = np.cumprod(powers, out=powers)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, width: int) -> np.ndarray:
        """Hashes of every range of ``width`` units, by its start."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` consecutive values, in log(width) passes."""
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = op(out[: len(out) - (width - have)], out[width - have :])
    return out


def segments(units: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Cut the windows of several sequences into segments by their rarest gram.

    ``units`` holds the sequences behind each other, ``bounds`` their limits.
    Each window of ``window`` units has as key the least hash of its ``gram``-unit
    substrings; consecutive windows with one key are one segment.  Equal windows
    have equal keys, so only segments with equal keys need comparing.

    Returns arrays (sequence, start, n, key, content, repeats): the segment has
    the ``n`` windows from ``start`` (within its sequence); ``content`` hashes
    its ``n + window - 1`` units; ``repeats`` tells that the key occurs more
    than once inside, so its own windows may equal each other.
    """
    lengths = np.diff(bounds)
    many = np.maximum(lengths - window + 1, 0)
    none = np.zeros(0, np.int64)
    if not many.sum():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    with np.errstate(over="ignore"):
        h = RangeHash(units, 11).all(gram)
        width = window - gram + 1
        low = _sliding(h, width, np.minimum)  # by window start
        owner = np.repeat(np.arange(len(lengths)), lengths)[: len(low)]
        valid = np.arange(len(low)) - bounds[owner] < many[owner]
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        n = np.bincount(run[valid], minlength=len(starts))
        # Places of h that are the least of a window; two neighbours with one value lie in one segment.
        held = np.where(valid, low, np.uint64(0))
        held = np.concatenate([np.zeros(width - 1, np.uint64), held, np.zeros(width - 1, np.uint64)])
        picked = np.flatnonzero(_sliding(held, width, np.maximum)[: len(h)] == h)
        pair = (h[picked[1:]] == h[picked[:-1]]) & (picked[1:] - picked[:-1] <= width)
        mark = np.zeros(len(low) + 2, np.int32)  # windows that may hold both places, or lie between them
        np.add.at(mark, np.clip(picked[1:][pair] - width + 1, 0, len(low)), 1)
        np.add.at(mark, np.clip(picked[:-1][pair] + 2, 0, len(low) + 1), -1)
        repeats = np.zeros(len(starts), bool)
        repeats[run[(np.cumsum(mark)[: len(low)] > 0) & valid]] = True
        content = RangeHash(units, 12)(starts, starts + n + window - 1)
    return owner[starts], starts - bounds[owner[starts]], n, low[starts], content, repeats
