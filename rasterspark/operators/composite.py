"""Temporal composites: one value per pixel and band out of a time series."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import OPTICAL
from ..functions.stacks import group_numbers, per_table
from ..sources.manifests import kept

PIXEL = ("aoi_id", "row", "col")


def _each(obs: DataFrame, make, bands, keys) -> DataFrame:
    return obs.groupBy(*keys).agg(*[make(b).alias(b) for b in bands])


def _between(obs: DataFrame, share: float, bands, keys) -> DataFrame:
    """The value at ``share`` of each sorted series, between its neighbours where it falls between two, as Spark's ``percentile`` gives it.

    A pixel has few observations, so a hash table for each pixel and band costs
    far more than the values: series are shuffled once and sorted as whole columns.
    """
    def run(table: pa.Table) -> pa.Table:
        group = group_numbers(table, keys)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out = {k: table[k].take(pa.array(first)) for k in keys}
        for b in bands:
            own = table[b].combine_chunks()
            there = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
            x, g = own.drop_null().to_numpy(), group[there]
            order = np.lexsort((x, g))  # NaN last, as in Spark
            x, n = x[order], np.bincount(g, minlength=len(first))
            at, start = share * (n - 1), np.cumsum(n) - n
            some = n > 0
            low, high, at = np.floor(at[some]).astype(np.int64), np.ceil(at[some]).astype(np.int64), at[some]
            a, c = x[start[some] + low], x[start[some] + high]
            with np.errstate(invalid="ignore"):
                value = np.where((low == high) | (a == c), a, (high - at) * a + (at - low) * c)
            full = np.zeros(len(first))
            full[some] = value
            out[b] = pa.array(full, mask=~some)
        return pa.table(out)

    rows = obs.select(*keys, *[F.col(b).cast("double").alias(b) for b in bands])
    kinds = dict(rows.dtypes)
    return per_table(rows, keys, run, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, *bands)))


def median(obs: DataFrame, bands=OPTICAL, keys=PIXEL) -> DataFrame:
    return _between(obs, 0.5, bands, keys)


def mean(obs: DataFrame, bands=OPTICAL, keys=PIXEL) -> DataFrame:
    return _each(obs, F.avg, bands, keys)


def percentile(obs: DataFrame, p: int = 50, bands=OPTICAL, keys=PIXEL) -> DataFrame:
    if int(p) != p or not 0 <= p <= 100:
        raise ValueError("a percentile is a whole number from 0 to 100")
    return _between(obs, p / 100, bands, keys)


def mosaic(obs: DataFrame, bands=OPTICAL, keys=PIXEL, order=("acq_date", "scene_id")) -> DataFrame:
    """Latest observation that is not missing, band by band."""
    latest = lambda b: F.max_by(F.col(b), F.when(F.col(b).isNotNull(), F.struct(*order)))
    return _each(obs, latest, bands, keys)


def medoid(obs: DataFrame, bands=OPTICAL, keys=PIXEL, order=("acq_date", "scene_id")) -> DataFrame:
    """The real observation nearest to the median; ties go to the least of ``order``.

    Only observations with all bands compete.  A pixel's observations (at most
    one for each scene) are gathered once; median and nearest come from the array.
    """
    whole = obs.where(" AND ".join(f"`{b}` IS NOT NULL" for b in bands))
    series = whole.groupBy(*keys).agg(F.collect_list(F.struct(*order, *bands)).alias("series"))
    last = F.size("series") - 1

    def middle(b: str):
        values = F.array_sort(F.transform("series", lambda x: x[b]))
        low, high = F.get(values, F.floor(last / 2).cast("int")), F.get(values, F.ceil(last / 2).cast("int"))
        return low + (high - low) * 0.5

    series = series.withColumns({f"_{b}": middle(b) for b in bands})
    far = lambda x: sum(((x[b] - F.col(f"_{b}")) * (x[b] - F.col(f"_{b}")) for b in bands), F.lit(0.0))
    best = F.array_min(F.transform("series", lambda x: F.struct(F.round(far(x), 12).alias("far"), *[x[c].alias(c) for c in (*order, *bands)])))
    return series.select(*keys, best.alias("best")).select(*keys, *[F.col(f"best.{c}").alias(c) for c in (*bands, *order)])


METHODS = {"median": median, "mean": mean, "percentile": percentile, "mosaic": mosaic, "medoid": medoid}


def composite(obs: DataFrame, method: str = "median", **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    return METHODS[method](obs, **options)


def overview(pixels: DataFrame, factor: int, bands=OPTICAL, keys=("aoi_id",)) -> DataFrame:
    """Average of blocks of ``factor`` by ``factor`` pixels."""
    down = lambda c: F.floor(F.col(c) / factor).alias(c)
    return pixels.groupBy(*keys, down("row"), down("col")).agg(*[F.avg(b).alias(b) for b in bands])


def pyramid(pixels: DataFrame, factors=(2, 4, 8, 16, 32), bands=OPTICAL, keys=("aoi_id",)) -> DataFrame:
    """(factor, keys, row, col, bands): averages of blocks for each factor, from one scan of the pixels.

    Each level adds up the sums and counts of the level before, a quarter of its
    rows or fewer; a factor must be a multiple of the one before.
    """
    if any(b % a for a, b in zip(factors, factors[1:], strict=False)):
        raise ValueError("each factor is a multiple of the one before")
    down = lambda by: [F.floor(F.col(c) / by).alias(c) for c in ("row", "col")]
    first = pixels.groupBy(*keys, *down(factors[0])).agg(*[f for b in bands for f in (F.sum(b).alias(f"{b}_sum"), F.count(b).alias(f"{b}_n"))])
    level, out = kept(first, "pyramid"), []
    for k, factor in enumerate(factors):
        if k:
            level = level.groupBy(*keys, *down(factor // factors[k - 1])).agg(*[F.sum(f"{b}_{x}").alias(f"{b}_{x}") for b in bands for x in ("sum", "n")])
        out.append(level.select(F.lit(factor).alias("factor"), *keys, "row", "col", *[F.try_divide(f"{b}_sum", f"{b}_n").alias(b) for b in bands]))
    return reduce(DataFrame.unionByName, out)
