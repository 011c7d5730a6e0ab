"""Mixing sources to target weights by cube-method balanced sampling.

Sources share the corpus size by weight; no source gets more than ``cap`` times
its own size, and what it can't take is shared again.  With r = target / size,
each document of a source is taken floor(r) times for certain and once more
with inclusion probability r - floor(r).  The flight phase of the cube method
moves these probabilities along vectors that change neither the expected words
nor the expected number of documents of the source, until each is 0 or 1; it
runs in blocks, and the few that stay open in each block meet in the next
round.  The last two of a source land on the nearest whole choice, and a few
exchanges mend the words that this leaves over.

Repeated rows (same id, source and size) are taken alike, so a source of many
of them may miss its target by as much as one such group holds.  Null id or
source is a value of its own; null text and empty text have size 0 and count as
documents.  Rows of equal size stand in the order of a hash of their ids.  Texts
of any length count whole.  An empty table gives no rows.  Other columns, of
whatever name, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialise, n_words, quoted, with_output

UNIT = "id long, source string, size long, n_rows long, pick double"


def targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), cap: float = 3.0) -> dict:
    """Target size by source: by weight, at most ``cap`` times its own size."""
    order = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    own, weight = dict(sizes), {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full, out = float(sum(own.values())), {}, {}
    while True:
        rest = [s for s in order if s not in full]
        left, shares = total - sum(full.values()), sum(weight[s] for s in rest)
        out = {s: left * weight[s] / shares for s in rest}
        over = [s for s in rest if out[s] > cap * own[s]]
        if not over:
            return out | full
        full |= {s: cap * own[s] for s in over}


def flight(picks: np.ndarray, rows: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move inclusion probabilities to 0 or 1, keeping sum(rows * p) and sum(rows * size * p).

    Two may stay between; ``land`` decides those with the least error in size,
    and then mends what error is left (see ``mended``).
    """
    p, a, b = picks.tolist(), rows.astype(float).tolist(), (rows * sizes).astype(float).tolist()
    waiting = [k for k in range(len(p) - 1, -1, -1) if 0 < p[k] < 1]
    draws = iter(rng.random(2 * len(p) + 4).tolist())
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            x, y, z = active
            u = [a[y] * b[z] - a[z] * b[y], a[z] * b[x] - a[x] * b[z], a[x] * b[y] - a[y] * b[x]]
            if not any(u):  # all of one size
                u = [a[y], -a[x], 0.0]
        elif len(active) == 2 and a[active[0]] * b[active[1]] == a[active[1]] * b[active[0]]:
            u = [a[active[1]], -a[active[0]]]
        else:
            break
        top = max(map(abs, u))
        u = [v / top for v in u]
        ahead = min(((1 - p[k]) / v if v > 0 else -p[k] / v) for k, v in zip(active, u, strict=True) if v)
        back = min((p[k] / v if v > 0 else (p[k] - 1) / v) for k, v in zip(active, u, strict=True) if v)
        step = ahead if next(draws, 0.5) * (ahead + back) < back else -back
        for k, v in zip(active, u, strict=True):
            p[k] += step * v
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        active = [k for k in active if 0 < p[k] < 1]
    if land and active:
        options = [[(choice >> j) & 1 for j in range(len(active))] for choice in range(1 << len(active))]
        error = lambda o: (abs(sum(b[k] * (c - p[k]) for k, c in zip(active, o, strict=True))), abs(sum(a[k] * (c - p[k]) for k, c in zip(active, o, strict=True))))
        for k, c in zip(active, min(options, key=error), strict=True):
            p[k] = float(c)
        return mended(np.array(p), b, float(np.dot(b, picks)))
    return np.array(p)


def mended(chosen: np.ndarray, words, total: float, most: int = 8) -> np.ndarray:
    """Whole choices whose words come nearer to ``total``.

    Each of at most ``most`` steps makes the one change that leaves the least
    error: a row in or out, or one in for one out.  Ties go to the first.
    """
    p, b = chosen.copy(), np.asarray(words, float)
    for _ in range(most):
        left = float(np.dot(b, p)) - total
        change = np.where(p > 0, -b, b)
        best = int(np.argmin(np.abs(left + change)))
        moves, error = [best], abs(left + change[best])
        outside, inside = np.flatnonzero(p == 0), np.flatnonzero(p > 0)
        if len(outside) and len(inside):
            inside = inside[np.argsort(b[inside], kind="stable")]
            wish = left + b[outside]  # what leaves in exchange should have this size
            for near in (np.searchsorted(b[inside], wish) + d for d in (-1, 0)):
                near = np.clip(near, 0, len(inside) - 1)
                off = np.abs(wish - b[inside[near]])
                k = int(np.argmin(off))
                if off[k] < error:
                    moves, error = [int(outside[k]), int(inside[near[k]])], float(off[k])
        if error >= abs(left):
            break
        p[moves] = 1.0 - p[moves]
    return p


#: With more sources than this, rows meet their source's figures by a salted shuffle.
MOST_BROADCAST, SALTS = 20_000, 64


def _with_source(rows: DataFrame, figures: DataFrame, broadcast: bool) -> DataFrame:
    """``rows`` with the figures of their source; one source may hold most rows."""
    same = rows["source"].eqNullSafe(figures["plan_source"])
    if broadcast:
        return rows.join(F.broadcast(figures), same).drop("plan_source")
    salted = figures.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, same & (F.pmod(F.xxhash64("id"), F.lit(SALTS)) == salted["plan_salt"])).drop("plan_source", "plan_salt")


def mix(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, seed: int = 7, block: int = 4096, most_broadcast: int = MOST_BROADCAST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How often each document is taken.

    Returns (id, source, size, n_rows, source_size, target, copies), one row for
    each distinct id, source and size; ``n_rows`` counts the rows that share
    them.  The driver gets one row per source (sum and count).
    """
    spark = docs.sparkSession
    own_id, own_source, own_text = (F.col(c) for c in quoted(id_col, source_col, text_col))
    units = docs.select(own_id.cast("long").alias("id"), own_source.cast("string").alias("source"), n_words(own_text).alias("size")).groupBy("id", "source", "size").agg(F.count("*").alias("n_rows"))
    units = materialise(units, "sizes")
    stats = [(r["source"], r["size"] or 0, r["n"]) for r in units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("size"), F.count("*").alias("n")).collect()]
    target = targets([(s, n) for s, n, _ in stats], weights, cap) if stats else {}
    plan = []
    for s, size, n in stats:
        r = min(target[s] / size, cap) if size else 0.0
        whole = math.floor(r + 1e-9)
        plan.append((s, size, target[s], whole, max(0.0, r - whole), n))
    of = spark.createDataFrame(plan, "plan_source string, source_size long, target double, whole int, part double, n long")
    units = _with_source(units, of, len(plan) <= most_broadcast)

    def fly(land_all: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["mark", "id", "size"], ignore_index=True)
            rng = np.random.default_rng([seed, int(pdf["mark"].iloc[0]) & 0xFFFFFFFF])
            pdf["pick"] = flight(pdf["pick"].to_numpy(), pdf["n_rows"].to_numpy(), pdf["size"].to_numpy(), rng, land_all or int(pdf["blocks"].iloc[0]) == 1)
            return pdf[["id", "source", "size", "n_rows", "pick"]]

        return run

    open_ = units.select("id", "source", "size", "n_rows", F.col("part").alias("pick"), "n")
    done, counts = None, {s: n for s, _, _, _, part, n in plan if part > 0}
    while counts:
        blocks = spark.createDataFrame([(s, math.ceil(n / block)) for s, n in counts.items()], "plan_source string, blocks int")
        step = _with_source(open_.where("pick > 0 AND pick < 1"), blocks, len(counts) <= most_broadcast)
        step = step.withColumn("mark", F.xxhash64("id", "size", F.lit(seed + len(counts))))
        step = step.withColumn("block", F.pmod("mark", F.col("blocks"))).select("id", "source", "size", "n_rows", "pick", "mark", "block", "blocks")
        flown = materialise(step.groupBy("source", "block").applyInPandas(fly(False), UNIT), "flight")
        decided = flown.where("pick IN (0, 1)")
        done = decided if done is None else done.unionByName(decided)
        open_ = flown
        counts = {r["source"]: r["n"] for r in flown.where("pick > 0 AND pick < 1").groupBy("source").agg(F.count("*").alias("n")).collect()}
    sure = units.where(F.col("part") <= 0).withColumn("pick", F.lit(0.0))
    keep = ["id", "source", "size", "n_rows", "pick"]
    done = sure.select(*keep) if done is None else done.select(*keep).unionByName(sure.select(*keep))
    return _with_source(done, of, len(plan) <= most_broadcast).select("id", "source", "size", "n_rows", "source_size", "target", (F.col("whole") + F.col("pick").cast("int")).alias("copies"))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", out: str = "copies", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, and how often, in column ``out`` (in place of one of that name).

    Columns of any other name pass through.
    """
    ident, source, size, copies = free_names(docs, "mix_id", "mix_source", "mix_size", "mix_copies")
    mixed = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options).where("copies > 0").select("id", "source", "size", "copies").toDF(ident, source, size, copies)
    own_id, own_source, own_text = (F.col(c) for c in quoted(id_col, source_col, text_col))
    same = own_id.cast("long").eqNullSafe(F.col(ident)) & own_source.cast("string").eqNullSafe(F.col(source)) & (n_words(own_text) == F.col(size))
    return docs.join(mixed, same).select(*with_output(docs, {out: F.col(copies)}))
