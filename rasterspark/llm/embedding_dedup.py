"""Embedding near-dedup by lattice hashing.

Vectors are scaled to length 1 and, in each of several tables, projected at
random to two times 8 dimensions and decoded to the nearest points of the E8
lattice; the points of both blocks name a cell.  Each vector also probes the
cells next to its own that its projection is nearest to.  A vector is compared
with those that own a cell it owns or probes, by cosine in double precision.  A
pair that meets in several tables is counted in the first of them, which both
members' cells tell, so that no list of pairs is ever made: only counts and
spanning forests leave a block of at most two chunks of a cell.

How fine the lattice is (``LADDER``) follows from how often a bounded sample of
``sample`` vectors that are not linked share a cell: the coarsest step is taken
with at most ``crowd`` expected strangers for a vector in a table, so the work
for each vector stays alike while the table grows, but for the larger number of
tables.  Every step finds a pair at cosine 0.9 with a chance of 0.96 or more
(simulated at 64 dimensions: 0.984, 0.985, 0.969, 0.973 and 0.961; from 0.93 on
0.998 or more).

Equal vectors (by 128 bits of hash) are one class with a count.  Vectors that
are null, zero, or hold null or non-finite components link with nothing;
vectors of different length don't link.  Null ids sort last and stay null.
Repeated rows are rows of one class.  An empty table gives no rows.  Other
columns, of whatever name, are not read.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, lean, materialise, mix64, whole_groups
from .links import by_block, components, in_chunks, local_forest, with_figures

#: (scale, probes, tables) from coarse to fine; the larger the scale, the larger the cells.
LADDER = ((2.0, 4, 12), (1.8, 4, 16), (1.6, 8, 17), (1.4, 8, 31), (1.2, 16, 44))
BLOCKS = 2


@functools.cache
def least_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: whole or half-whole coordinates with an even sum."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def cells(vectors: np.ndarray, table: int, blocks: int, scale: float, probes: int) -> np.ndarray:
    """(n, 1 + probes) cell hashes in one table: the own cell, then the nearest neighbours."""
    n, d = vectors.shape
    rng = np.random.default_rng([table, d])
    point, gain = [], []
    for _ in range(blocks):
        x = vectors @ (rng.normal(size=(d, 8)) / scale)
        point.append(decode(x))
        gain.append((x - point[-1]) @ least_vectors().T)
    gain = np.concatenate(gain, axis=1)
    moves = np.argpartition(-gain, probes, axis=1)[:, :probes] if probes else np.zeros((n, 0), int)
    weight = mix64(np.arange(1, 8 * blocks + 1, dtype=np.uint64) + np.uint64(1000 * table + d)) | np.uint64(1)
    name = lambda p, w: ((2 * p).astype(np.int64).view(np.uint64) * w).sum(axis=-1)
    with np.errstate(over="ignore"):
        own = name(np.concatenate(point, axis=1), weight)
        steps = np.concatenate([name(least_vectors(), weight[8 * k : 8 * k + 8]) for k in range(blocks)])
        return mix64(np.concatenate([own[:, None], own[:, None] + steps[moves]], axis=1))


def unit_rows(vectors) -> np.ndarray:
    """Rows in double precision, scaled to length 1."""
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def shared_cells(x: np.ndarray, threshold: float, scale: float, tables: int = 8) -> float:
    """How likely two sampled vectors below the threshold own one cell of a table."""
    if len(x) < 2:
        return 0.0
    strange = 1 - (x @ x.T >= threshold).mean()
    found = 0.0
    for table in range(tables):
        own = cells(x, table, BLOCKS, scale, 0)[:, 0]
        order = np.argsort(own)
        for group in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(group) > 1:
                found += (x[group] @ x[group].T < threshold).sum()
    return found / (tables * len(x) * len(x) * max(strange, 1e-9))


def step_for(x: np.ndarray, n: int, threshold: float, crowd: float) -> tuple[float, int, int]:
    """The coarsest step of the ladder with at most ``crowd`` expected strangers in the cells that a vector visits in a table."""
    for scale, probes, tables in LADDER:
        if shared_cells(x, threshold, scale) * n * (1 + probes) <= crowd:
            return scale, probes, tables
    return LADDER[-1]


def meet_before(visited: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Which pairs (i, j) of rows of visited cells already met in a table before ``table``."""
    met = np.zeros(len(i), bool)
    for t in range(table):
        left = np.flatnonzero(~met)
        if not len(left):
            break
        there = visited[:, t * (1 + probes) : (t + 1) * (1 + probes)]
        a, b = there[i[left]], there[j[left]]
        met[left] = (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)
    return met


def linked(x: np.ndarray, owns: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Pairs (i, j), i from ``a`` and j from ``b``, at the threshold, of which one at least owns the cell."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        close = (x[part] @ x[b].T >= threshold) & (owns[part, None] | owns[None, b])
        if same:
            close &= part[:, None] < b[None, :]
        row, col = np.nonzero(close)
        i.append(part[row]), j.append(b[col])
    return np.concatenate(i), np.concatenate(j)


def small_blocks(x: np.ndarray, owns: np.ndarray, block: np.ndarray, threshold: float):
    """The same for many whole blocks at a time, each block's rows being adjacent."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, len(block)):
        at = np.flatnonzero(block[step:] == block[:-step])
        if not len(at):
            break
        at = at[owns[at] | owns[at + step]]
        at = at[np.einsum("ij,ij->i", x[at], x[at + step]) >= threshold]
        i.append(at), j.append(at + step)
    return np.concatenate(i), np.concatenate(j)


#: Cells of so few vectors are compared many at a time.
FEW = 64


def lattice_join(vectors: DataFrame, threshold: float = 0.9, step: tuple | None = None, sample: int = 2048, crowd: float = 64.0, chunk: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    ``step`` (scale, probes, tables) overrides the choice from the sample.
    """
    vector = F.col(vector_col).cast("array<double>")
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.when(sound, vector).alias("vector"))
    rows = materialise(rows.select("id", "vector", F.when(F.col("vector").isNotNull(), F.struct(F.xxhash64("vector", F.size("vector")).alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))).alias("key")), "vectors", 4096)
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.first("vector").alias("vector"))
    classes = materialise(classes.withColumn("node", F.col("key.a")), "classes", 4096)
    if step is None:
        n = classes.count()
        drawn = classes.where(F.pmod("node", F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(n, 1))).select("vector").limit(2 * sample).toPandas()
        sizes = drawn["vector"].str.len()
        usual = drawn["vector"][sizes == sizes.mode().iloc[0]] if len(drawn) else drawn["vector"]
        step = step_for(unit_rows(usual) if len(usual) else np.zeros((0, 8)), n, threshold, crowd)
    scale, probes, tables = step

    def visit(frames):
        for pdf in frames:
            for _, part in pdf.groupby(pdf["vector"].str.len()):
                x, node = unit_rows(part["vector"]), part["node"].to_numpy()
                for table in range(tables):
                    found = cells(x, table, BLOCKS, scale, probes)
                    yield pd.DataFrame({"cell": found.ravel().view(np.int64), "node": np.repeat(node, 1 + probes), "at_table": np.int32(table), "own": np.tile(np.arange(1 + probes) == 0, len(node))})

    def count(i, j, part, x):
        """(a, b, n) rows: a spanning forest of the pairs of some blocks, and the links that count here."""
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        i, j = at[: len(i)], at[len(i) :]
        node, copies, table, cell = (part[c].to_numpy()[used] for c in ("node", "copies", "at_table", "cell"))
        visited = np.concatenate([cells(x[used], t, BLOCKS, scale, probes) for t in range(tables)], axis=1).view(np.int64)
        own = visited[np.arange(len(used)), table * (1 + probes)]
        # of two vectors that probe each other's cells, the pair counts in the cell of the lesser node
        first = np.where(node[i] < node[j], i, j)
        other = np.where(first == i, j, i)
        probed = np.zeros(len(i), bool)
        for p in range(1, 1 + probes):
            probed |= visited[other, table[other] * (1 + probes) + p] == own[first]
        new = (own[i] == own[j]) | (cell[i] == own[first]) | ~probed
        for t in np.unique(table[i[new]]):
            mine = np.flatnonzero(new & (table[i] == t))
            new[mine] = ~meet_before(visited, i[mine], j[mine], int(t), probes)
        n = np.bincount(i[new], copies[j[new]], len(used)) + np.bincount(j[new], copies[i[new]], len(used))
        low = local_forest(len(used), i, j)
        some = np.flatnonzero((n > 0) | (low != np.arange(len(used))))
        return pd.DataFrame({"a": node[low[some]], "b": node[some], "n": n[some].astype(np.int64)})

    def compare(frames):
        for rows in whole_groups(frames, ["cell", "left", "right"]):
            length = rows["vector"].str.len().to_numpy()
            for d in np.unique(length):
                part = rows[length == d].reset_index(drop=True)
                x = unit_rows(part["vector"])
                block = part.groupby(["cell", "left", "right"], sort=False).ngroup().to_numpy()
                side, owns = part["side"].to_numpy(), part["own"].to_numpy()
                few = (np.bincount(block)[block] <= FEW) & (side == 2)
                at = np.flatnonzero(few)
                i, j = small_blocks(x[at], owns[at], block[at], threshold)
                pairs = [(at[i], at[j])]
                for k in np.unique(block[~few]):
                    own = np.flatnonzero(block == k)
                    pairs.append(linked(x, owns, own[side[own] != 1], own[side[own] != 0], threshold, bool((side[own] == 2).all())))
                i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
                if len(i):
                    yield count(i, j, part, x)

    visits = materialise(classes.select("node", "vector").mapInPandas(lean(visit), "cell long, node long, at_table int, own boolean"), "visits", 4096)
    members, tasks = in_chunks(visits, "cell", "node", chunk, F.max("own"), rows_a_task=10_000)
    members = by_block(members.join(classes.select("node", "vector", "copies"), "node"), ["cell", "left", "right"], tasks)
    found = materialise(members.mapInPandas(lean(compare), "a long, b long, n long"), "links", 2048)
    counted = found.groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("n"))
    clusters = components(found.select("a", "b")).select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    told = classes.select("key", "node", "copies", "id").join(counted, "node", "left").join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    least = told.groupBy("cluster").agg(F.min("id").alias("component_id"))
    told = materialise(told.join(least, "cluster").select("key", "copies", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "figures")
    named, bare = rows.select("id", "key").where("key IS NOT NULL"), rows.where("key IS NULL")
    out = with_figures(named, told, "key", "copies", named.count()).select("id", "n_links", "component_id")
    out = out.unionByName(bare.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(known("id").alias(id_col), "n_links", known("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
