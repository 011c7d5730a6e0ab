"""Links between rows: work in blocks of two chunks, connected components, figures of a row's class."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Keys with more than one row in so many have a join of their own: at most as many keys as this.
HOT_SHARE = 1000


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n rows' component, given the edges (a, b) of a block."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    return label


def in_chunks(members: DataFrame, group: str, row: str, most: int, only=None, rows_a_task: int = 20_000, pairs_a_task: int = 4_000_000) -> tuple[DataFrame, int]:
    """Deal each group's rows out to blocks (``group``, ``left``, ``right``) of two chunks.

    A group of n rows has ceil(n / most) chunks; each pair of chunks, and each
    chunk with itself, is one block, so no task gets more than two chunks of a
    group and each pair of rows meets in exactly one block.  ``side`` tells
    which chunk a row stands for (0 left, 1 right, 2 both).  ``only`` may be a
    boolean aggregate that a group must fulfil.

    Also returns the number of tasks that the rows and pairs to compare call for.
    """
    counts = members.groupBy(group).agg(F.count("*").alias("n_rows"), (F.lit(True) if only is None else only).alias("wanted")).where("n_rows > 1 AND wanted").drop("wanted")
    counts = materialise(counts, "groups", 10_000)
    found = counts.agg(F.sum(F.col("n_rows") * F.ceil(F.col("n_rows") / most)).alias("rows"), F.sum(F.col("n_rows").cast("double") * F.least("n_rows", F.lit(2 * most))).alias("pairs")).first()
    tasks = max(1, math.ceil((found["rows"] or 0) / rows_a_task), math.ceil((found["pairs"] or 0) / pairs_a_task))
    dealt = members.join(counts, group).withColumn("chunks", F.ceil(F.col("n_rows") / most).cast("int")).withColumn("own_chunk", F.pmod(F.xxhash64(row), F.col("chunks")).cast("int"))
    other = dealt.withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = other.select(
        *members.columns,
        F.least("own_chunk", "other_chunk").alias("left"),
        F.greatest("own_chunk", "other_chunk").alias("right"),
        F.when(F.col("own_chunk") == F.col("other_chunk"), 2).when(F.col("own_chunk") < F.col("other_chunk"), 0).otherwise(1).alias("side"),
    )
    return blocks, min(tasks, 100_000)


def by_block(blocks: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Blocks dealt out to ``tasks`` tasks, the rows of each next to each other (sorted, so that Spark may spill)."""
    return blocks.repartition(tasks, *keys).sortWithinPartitions(*keys)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that an edge (a, b) names: the least id it is linked with.

    Each round takes the least label among neighbours, hands it to all that
    share a label, and jumps to the label's own label; each ends in a table in
    the shared folder, and the tables of the round before go.
    """
    one_way = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges", 10_000)
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", 10_000)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("of_b")), "b").groupBy(F.col("a").alias("id")).agg(F.min("of_b").alias("near"))
        told = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        roots = told.groupBy("label").agg(F.min("low").alias("best"))
        lower = materialise(told.join(roots, "label").select("id", F.col("label").alias("old"), F.least("low", "best").alias("label")), "labels", 10_000)
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = materialise(lower.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")), "labels", 10_000)
        discard(labels, lower)
        labels = moved
        if not moved.where("old <> label").limit(1).count():
            discard(one_way)
            return moved.select("id", F.col("label").alias("component"))


def with_figures(rows: DataFrame, figures: DataFrame, key: str, count: str, n_rows: int) -> DataFrame:
    """``rows`` left-joined with the figures of their class, of which one may hold most rows.

    ``count`` says how many of the ``n_rows`` rows have a key.  Keys with more
    than a thousandth of them, so a thousand at most, are broadcast; the others
    are joined by a shuffle that no key of theirs can burden.
    """
    is_hot = F.col(count) * HOT_SHARE > n_rows
    hot = figures.where(is_hot)
    frequent = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(figures.where(~is_hot), key, "left")
    return frequent.unionByName(rest)
