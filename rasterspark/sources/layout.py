"""Pixels stored along a space-filling curve, so that a window reads only what lies near it.

Rows and columns are interleaved bit by bit to ``z``; files are cut and sorted
by ``z`` and lie in folders by its first bits (``zone``).  A window is a few
ranges of the curve: they prune folders, and row groups by their least and
greatest ``z``; what is left outside the window goes by row and column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a row or column.
BITS = 31
#: A zone is a square of 2**ZONE rows and columns.
ZONE = 12


def _spread(x: Column) -> Column:
    """The bits of a number below 2**31 at every other place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def curve(row: Column, col: Column) -> Column:
    """Place of a cell on the curve; rows and columns lie within 0 and 2**31 - 1."""
    return F.shiftleft(_spread(row.cast("long")), 1).bitwiseOR(_spread(col.cast("long")))


def ranges(row_min: int, row_max: int, col_min: int, col_max: int, most: int = 32) -> list[tuple[int, int]]:
    """At most ``most`` ranges [low, high] of the curve that cover a half-open window.

    The square of all cells is cut in four, again and again, where the window
    cuts through it, coarse squares first, as long as there may be more ranges.
    """
    if row_min >= row_max or col_min >= col_max:
        return []
    row_min, col_min = max(0, row_min), max(0, col_min)
    done, open_ = [], [(0, 0, 0, BITS)]  # curve start, row, col, bits of the side
    while open_:
        cut = []
        for z, r, c, bits in open_:
            side = 1 << bits
            if r >= row_max or r + side <= row_min or c >= col_max or c + side <= col_min:
                continue
            inside = row_min <= r and r + side <= row_max and col_min <= c and c + side <= col_max
            (done if inside or not bits else cut).append((z, r, c, bits))
        if len(done) + 4 * len(cut) > 4 * most:
            done += cut
            break
        open_ = [(z + (k << (2 * (bits - 1))), r + (k >> 1 << (bits - 1)), c + ((k & 1) << (bits - 1)), bits - 1) for z, r, c, bits in cut for k in range(4)]
    spans = sorted((z, z + (1 << (2 * bits)) - 1) for z, _, _, bits in done)
    joined = []
    for low, high in spans:
        if joined and joined[-1][1] + 1 >= low:
            joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
        else:
            joined.append((low, high))
    while len(joined) > most:  # close the narrowest gaps
        k = min(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1])
        joined[k - 1 : k + 1] = [(joined[k - 1][0], joined[k][1])]
    return joined


def write(pixels: DataFrame, path: str, rows_a_file: int = 4_000_000, n_rows: int | None = None, zone: int = ZONE) -> None:
    """Write (row, col, ...) along the curve; a cell outside 0 to 2**31 - 1, or without place, is an error."""
    bad = F.col("row").isNull() | F.col("col").isNull() | (F.least("row", "col") < 0) | (F.greatest("row", "col") >= 1 << BITS)
    placed = pixels.withColumn("z", F.when(bad, F.raise_error(F.lit("a pixel lies outside the grid")).cast("long")).otherwise(curve(F.col("row"), F.col("col"))))
    placed = placed.withColumn("zone", F.shiftright("z", 2 * zone))
    n = pixels.count() if n_rows is None else n_rows
    placed.repartitionByRange(max(1, math.ceil(n / rows_a_file)), "z").sortWithinPartitions("z").write.option("maxRecordsPerFile", rows_a_file).partitionBy("zone").parquet(path)


def read(spark: SparkSession, path: str, row_min: int, row_max: int, col_min: int, col_max: int, most: int = 32, zone: int = ZONE) -> DataFrame:
    """The pixels of a half-open window, by ranges that reach the scan as filters."""
    spans = ranges(row_min, row_max, col_min, col_max, most)
    near = F.lit(False)
    for low, high in spans:
        near = near | (F.col("z").between(low, high) & F.col("zone").between(low >> (2 * zone), high >> (2 * zone)))
    inside = (F.col("row") >= row_min) & (F.col("row") < row_max) & (F.col("col") >= col_min) & (F.col("col") < col_max)
    return spark.read.parquet(path).where(near & inside).drop("z", "zone")
