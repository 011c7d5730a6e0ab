"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents of equal text are one group, and a group is never cut.  Groups enter,
largest first, the bin with the least remaining capacity that still holds them;
a balanced search tree over (remaining capacity, bin) finds it.

This runs on two levels, so that no task sees all groups.  A grain is 1/1024 of
a shard.  Each task packs its groups below a grain into parcels of a grain, in
one pass over them in falling order; parcels and larger groups, of which there
are few (2 * 1024 for each shard, and one for each task), are packed into
shards.  Two forms:

* ``capacity``: as few shards of that capacity as best fit needs; a group larger
  than the capacity has a shard of its own.  Beyond ``REGION`` grains the parcels
  are dealt by hash into regions, each packed by a task of its own.
* ``shards``: that many shards of nearly equal bytes.  A group above an equal
  share of what is left has a shard of its own; for the others bisection finds
  the least capacity at which best fit needs no more shards.  Shards that hold
  several groups then differ by about a grain.

Rows get their place from sums, without ordering a shard in a task: first row of
the parcel in its shard, of the group in its parcel, of the part (the group's
rows in one input partition) in its group, and the row in its part.

Null text is a group of its own, without bytes; empty texts are another one.
Each row weighs its UTF-8 bytes plus 1.  Repeated rows are rows of one group.
Groups of equal size stand in the order of their hash.  Texts of any length
count whole.  An empty table gives no rows.  Ids pass through whatever their
type; other columns, of whatever name, are not read unless ``keep`` names them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise, mix64, quoted

#: Grains in a shard; the fewest where there are very many shards.
GRAINS, FEWEST = 1024, 64
#: Grains that one task packs.
REGION = 1 << 18


class BinTree:
    """Bins by (remaining capacity, number) in a treap; ``put`` enters the tightest one that fits."""

    def __init__(self, capacity: int, most: int | None = None):
        self.capacity, self.most, self.bins = capacity, most, 0
        self.key, self.order, self.left, self.right = [], [], [], []  # by bin
        self.root = -1

    def _split(self, node: int, key: tuple[int, int]) -> tuple[int, int]:
        """(bins below ``key``, the others)."""
        if node < 0:
            return -1, -1
        if self.key[node] < key:
            self.right[node], high = self._split(self.right[node], key)
            return node, high
        low, self.left[node] = self._split(self.left[node], key)
        return low, node

    def _merged(self, low: int, high: int) -> int:
        if low < 0 or high < 0:
            return max(low, high)
        if self.order[low] < self.order[high]:
            self.right[low] = self._merged(self.right[low], high)
            return low
        self.left[high] = self._merged(low, self.left[high])
        return high

    def _enter(self, bin_: int, remaining: int) -> None:
        self.key[bin_], self.left[bin_], self.right[bin_] = (remaining, bin_), -1, -1
        low, high = self._split(self.root, (remaining, bin_))
        self.root = self._merged(self._merged(low, bin_), high)

    def _leave(self, bin_: int) -> None:
        low, high = self._split(self.root, self.key[bin_])
        _, high = self._split(high, (self.key[bin_][0], bin_ + 1))
        self.root = self._merged(low, high)

    def put(self, size: int) -> int:
        """The bin that an item enters; -1 if it fits none and no bin may be added."""
        node, found = self.root, -1
        while node >= 0:
            if self.key[node][0] >= size:
                node, found = self.left[node], node
            else:
                node = self.right[node]
        if found < 0:
            if self.most is not None and self.bins >= self.most:
                return -1
            found, self.bins = self.bins, self.bins + 1
            self.key.append((0, found)), self.left.append(-1), self.right.append(-1)
            self.order.append(int(mix64(np.array([found + 1]))[0]))
            if self.capacity > size:
                self._enter(found, self.capacity - size)
            return found
        left = self.key[found][0] - size
        self._leave(found)
        if left:  # full bins need no place in the tree
            self._enter(found, left)
        return found


def best_fit(sizes, capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each of the falling ``sizes``; None if they need more than ``most`` bins."""
    tree, out = BinTree(capacity, most), []
    for size in sizes:
        out.append(tree.put(size))
        if out[-1] < 0:
            return None
    return out


def even_bins(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to ``shards`` - 1 of nearly equal sums for the falling ``sizes``."""
    alone, left = 0, sum(sizes)
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) > left:
        left -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low = max(rest[0], -(-left // bins))
    high = low + rest[0]  # always enough: an item that fits nowhere would find every bin above the mean
    found = best_fit(rest, high, bins)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(rest, middle, bins)
        low, high, found = (middle + 1, high, found) if tried is None else (low, middle, tried)
    return [*range(alone), *(alone + b for b in found)]


def pack(groups: DataFrame, shards: int | None = None, capacity: int | None = None, groups_a_task: int = 200_000) -> DataFrame:
    """(key, shard, base) of each group (key, bytes, rows); ``base`` is the place of its first row in the shard.

    Either ``shards`` or ``capacity`` is given.
    """
    if (shards is None) == (capacity is None) or (shards or capacity) < 1:
        raise ValueError("one of shards and capacity, above 0")
    grains = min(GRAINS, max(FEWEST, REGION // shards)) if shards else GRAINS
    if shards is not None and shards * grains > 16 * REGION:
        raise ValueError(f"{shards} shards are too many for one task: give a capacity")
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    grain = max(1, (total // shards if shards else capacity) // grains)
    regions = 1 if shards else max(1, math.ceil(total / grain / REGION))

    def parcels(frames):
        """Groups in falling order: those of a grain or more are parcels of their own."""
        first, tree, alone, before = TaskContext.get().partitionId() << 40, BinTree(grain), 0, {}
        for frame in frames:
            bin_, base = [], []
            for size, rows in zip(frame["bytes"].tolist(), frame["rows"].tolist(), strict=True):
                if size >= grain:
                    alone += 1
                    bin_.append((1 << 39) + alone)
                    base.append(0)
                    continue
                b = tree.put(size)
                bin_.append(b)
                base.append(before.get(b, 0))
                before[b] = base[-1] + rows
            yield pd.DataFrame({"key": frame["key"], "bytes": frame["bytes"], "rows": frame["rows"], "parcel": first + np.array(bin_, np.int64), "within": np.array(base, np.int64)})

    tasks = max(1, min(100_000, math.ceil(n / groups_a_task)))
    dealt = groups.select("key", "bytes", "rows").repartition(tasks, "key").sortWithinPartitions(F.desc("bytes"), "key")
    packed = materialise(dealt.mapInPandas(lean(parcels), "key binary, bytes long, rows long, parcel long, within long"), "parcels", 10_000)

    def into_shards(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "parcel"], ascending=[False, True], ignore_index=True)
        sizes = frame["bytes"].tolist()
        if shards:
            frame["shard"] = even_bins(sizes, shards)
        else:
            over = sum(s > capacity for s in sizes)
            frame["shard"] = [*range(over), *(over + b for b in best_fit(sizes[over:], capacity))]
        frame["start"] = frame.groupby("shard")["rows"].cumsum() - frame["rows"]
        return frame[["parcel", "region", "shard", "start"]]

    sums = packed.groupBy("parcel").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).withColumn("region", F.pmod(F.xxhash64("parcel"), F.lit(regions)).cast("int"))
    placed = materialise(sums.groupBy("region").applyInPandas(into_shards, "parcel long, region int, shard int, start long"), "shards", 10_000)
    if regions > 1:
        used = {r["region"]: r["n"] for r in placed.groupBy("region").agg((F.max("shard") + 1).alias("n")).collect()}
        before = placed.sparkSession.createDataFrame([(r, sum(used[q] for q in used if q < r)) for r in used], "region int, before int")
        placed = placed.join(F.broadcast(before), "region").withColumn("shard", F.col("shard") + F.col("before"))
    return packed.join(placed.select("parcel", "shard", "start"), "parcel").select("key", "shard", (F.col("start") + F.col("within")).alias("base"))


def shard_documents(docs: DataFrame, shards: int | None = None, capacity: int | None = None, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of every row, and the columns that ``keep`` names.

    ``slot`` numbers a shard's rows from 0 without gaps; a group's rows lie together.
    """
    own_id, text = (F.col(c) for c in quoted(id_col, text_col))
    text = text.cast("string")
    key = F.unhex(F.when(text.isNull(), F.lit("")).otherwise(F.md5(text)))
    carried = F.struct(*(F.col(c) for c in quoted(*keep))) if keep else F.lit(None).cast("string")
    rows = docs.select(
        key.alias("key"), F.monotonically_increasing_id().alias("row"), own_id.alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), carried.alias("kept"),
    )
    rows = materialise(rows.withColumn("part", F.shiftright("row", 33)), "rows")
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    parts = materialise(parts.withColumn("ahead", F.sum("rows").over(Window.partitionBy("key").orderBy("part")) - F.col("rows")), "parts", 10_000)
    groups = parts.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    placed = parts.join(pack(groups, shards, capacity), "key").select("key", "part", "shard", (F.col("base") + F.col("ahead")).alias("first"))
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("row")).cast("long") - 1
    out = rows.join(placed, ["key", "part"]).withColumn("slot", F.col("first") + within)
    kept = [F.col("kept")[c].alias(c) for c in keep if c.lower() not in {id_col.lower(), "size", "text_crc32", "shard", "slot"}]
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", *kept)


def write_shards(docs: DataFrame, path: str, rows_a_file: int = 1_000_000, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet below ``path``, a folder for each shard, files of ``rows_a_file`` rows in the order of slots."""
    told = shard_documents(docs, shards, capacity, tuple(docs.columns), id_col, text_col)
    told = told.withColumn("file_", F.floor(F.col("slot") / rows_a_file))
    told.repartition("shard", "file_").sortWithinPartitions("shard", "file_", "slot").drop("file_").write.partitionBy("shard").mode("errorifexists").parquet(path)
