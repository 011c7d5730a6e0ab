"""Whitening of embeddings by the singular value decomposition of the centred rows.

Components c of a vector, in double precision, become whole numbers
floor(64 * c) + 1000000, so counts and sums are exact.  Then, on Spark:

1. Count and sums by task, added.
2. Blockwise QR: each task reduces its centred rows, block after block, to one
   triangle R; triangles are joined in a tree of fan-in 16.
3. The last R, of the size of the dimension, is made bidiagonal by Householder
   reflections.  dqds finds its singular values to high relative accuracy, and
   twisted factorisations give their right vectors; reflections carry these back.
4. Each row is projected, and the covariance of what comes out is measured.

A bidiagonal matrix that falls apart is solved part by part.  Values that lie so
close together that twisted factorisations alone would not give orthogonal
vectors are orthogonalised and refined together, in their own subspace.

Rows whose vector is null, or holds null or non-finite components or such beyond
2**55, are left out, as are vectors of another length than the commonest
(the shortest of those on ties) and empty ones.  Null ids stay null; repeated rows count
each; directions without variance (below 1e-10 of the largest singular value)
give no component.  An empty table, and one of equal vectors, gives no rows.
Ids pass through whatever their type; other columns, of whatever name, are not read.
``deviation`` is null where it is no 64-bit number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, quoted

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 55)
#: Rows of a block, triangles that a task joins.
BLOCK, FAN_IN = 4096, 16
#: Singular values below this share of the largest count as zero.
ZERO = 1e-10
#: Neighbours nearer than this, relative to their size, are solved together.
CLOSE = 1e-3

EPS = np.finfo(float).eps


# The dense part: all of the size of the dimension


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, always square."""
    r = np.linalg.qr(rows, mode="r")
    d = rows.shape[1]
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, reflections of the right side) of a square matrix."""
    a, d, right = r.copy(), len(r), []
    for k in range(d):
        v, beta = _reflection(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            w, beta = _reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ w, w)
            right.append(w * math.sqrt(beta))
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta) so that x - beta v (v . x) has one entry, its first."""
    v, top = x.copy(), np.abs(x).max(initial=0.0)
    if len(x) < 2 or not top or not np.abs(x[1:]).max():
        return v * 0, 0.0
    v /= top
    v[0] += math.copysign(math.sqrt(v @ v), v[0])
    return v, 2.0 / (v @ v)


def carried_back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Vectors (columns) of the bidiagonal matrix as vectors of the matrix that was reduced."""
    out = z.copy()
    for k in range(len(right) - 1, -1, -1):
        w = right[k]
        out[k + 1 :] -= np.outer(w, w @ out[k + 1 :])
    return out


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform with a shift; None if it would turn negative."""
    n, d = len(q), q[0] - shift
    if d < 0:
        return None
    out_q, out_e, least = [0.0] * n, [0.0] * (n - 1), d
    for k in range(n - 1):
        s = d + e[k]
        out_q[k] = s
        if s == 0.0:
            d = q[k + 1] - shift
        else:
            ratio = q[k + 1] / s
            out_e[k] = e[k] * ratio
            d = d * ratio - shift
        if d < 0:
            return None
        least = min(least, d)
    out_q[-1] = d
    return out_q, out_e, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values, falling, of the upper bidiagonal matrix with diagonal ``a`` and superdiagonal ``b``."""
    top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if not top:
        return np.zeros(len(a))
    found, stack = [], [(((a / top) ** 2).tolist(), ((b / top) ** 2).tolist(), 0.0)]
    while stack:
        q, e, gone = stack.pop()  # gone: shifts so far
        if q[0] < q[-1]:  # the small values are to come out at the end
            q, e = q[::-1], e[::-1]  # the flipped transpose is upper bidiagonal too
        least = 0.0
        while True:
            n = len(q)
            if n == 1:
                found.append(q[0] + gone)
                break
            if e[-1] <= EPS * EPS * (gone + q[-1]) or e[-1] == 0.0:
                found.append(q.pop() + gone)
                e.pop()
                least = 0.0
                continue
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (gone + q[k + 1])), None)
            if cut is not None:
                stack.append((q[: cut + 1], e[:cut], gone))
                q, e = q[cut + 1 :], e[cut + 1 :]
                least = 0.0
                continue
            shift = min(least, _least_of_pair(q[-2], e[-1], q[-1])) if gone or least else 0.0
            done = _sweep(q, e, shift)
            while done is None:
                shift = shift * 0.25 if shift > 1e-30 else 0.0
                done = _sweep(q, e, shift)
            q, e, least = done
            gone += shift
            least *= 0.9
    return top * np.sqrt(np.sort(np.array(found))[::-1])


def _least_of_pair(q1: float, e: float, q2: float) -> float:
    """Least eigenvalue of the last two by two block of B B'."""
    t, det = q1 + e + q2, q1 * q2
    root = math.sqrt(max(t * t - 4 * det, 0.0))
    return 2 * det / (t + root) if t + root else 0.0


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit right vector of the bidiagonal matrix for a singular value, by the best twisted factorisation of B'B - value**2."""
    n, shift = len(a), value * value
    q, e = (a * a).tolist(), (b * b).tolist()
    tiny = EPS * EPS * max(max(q), shift, 1e-300)
    # B'B = L D L' with D = q and L's entries b / a; stationary transform from the top, progressive one from the bottom
    s, up = [-shift], []
    for k in range(n - 1):
        pivot = q[k] + s[k]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        up.append(a[k] * b[k] / pivot)
        s.append(e[k] * s[k] / pivot - shift)
    p, down = [0.0] * n, [0.0] * (n - 1)
    p[-1] = q[-1] - shift
    for k in range(n - 2, -1, -1):
        pivot = e[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        down[k] = a[k] * b[k] / pivot
        p[k] = q[k] * p[k + 1] / pivot - shift
    gamma = [s[k] + p[k] + shift for k in range(n)]
    r = min(range(n), key=lambda k: abs(gamma[k]))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -up[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -down[k] * z[k]
    return z / math.sqrt(z @ z)


def _parts(a: np.ndarray, b: np.ndarray) -> list[slice]:
    """Where a bidiagonal matrix falls apart."""
    top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * top) + 1).tolist(), len(a)]
    return [slice(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]


def right_vectors(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``most`` largest singular values above zero."""
    d, found = len(a), []
    for part in _parts(a, b):
        own_a, own_b = a[part], b[part.start : part.stop - 1]
        found += [(value, part, own_a, own_b) for value in dqds(own_a, own_b)]
    found.sort(key=lambda x: -x[0])
    least = ZERO * found[0][0] if found else 0.0
    sound = [x for x in found if x[0] > least]
    # a value's neighbours belong to it beyond the last wanted one too
    wanted = min(most, len(sound))
    while 0 < wanted < len(sound) and sound[wanted - 1][0] - sound[wanted][0] < CLOSE * sound[wanted - 1][0]:
        wanted += 1
    values, z = np.array([x[0] for x in sound[:wanted]]), np.zeros((d, wanted))
    for k, (value, part, own_a, own_b) in enumerate(sound[:wanted]):
        z[part, k] = twisted(own_a, own_b, value)
    at = 0
    for to in range(1, wanted + 1):
        if to == wanted or values[to - 1] - values[to] >= CLOSE * values[to - 1]:
            if to - at > 1:
                values[at:to], z[:, at:to] = _refined(a, b, values[at:to], z[:, at:to])
            at = to
    return values[:most], z[:, :most]


def _refined(a: np.ndarray, b: np.ndarray, values: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cluster's vectors, made orthogonal and turned to the singular directions within their subspace."""
    rng = np.random.default_rng(len(a))
    left = _orthonormal(z, rng)
    for _ in range(6):
        for j, value in enumerate(values):  # one step of inverse iteration each, then orthogonal again
            left[:, j] = _solved(a, b, value * (1 + (j + 1) * 4 * EPS), left[:, j])
        left = _orthonormal(left, rng)
    image = a[:, None] * left
    image[:-1] += b[:, None] * left[1:]
    _, s, turn = np.linalg.svd(image, full_matrices=False)
    return s, left @ turn.T


def _orthonormal(z: np.ndarray, rng) -> np.ndarray:
    """Gram-Schmidt, twice; a column that vanishes is drawn anew."""
    out = z.copy()
    for j in range(out.shape[1]):
        for _ in range(3):
            before = math.sqrt(out[:, j] @ out[:, j])
            for _ in range(2):
                out[:, j] -= out[:, :j] @ (out[:, :j].T @ out[:, j])
            norm = math.sqrt(out[:, j] @ out[:, j])
            if norm > 1e-8 * max(before, 1e-300):
                break
            out[:, j] = rng.normal(size=len(out))
        out[:, j] /= norm
    return out


def _solved(a: np.ndarray, b: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    """(B'B - value**2) y = x by elimination with row exchanges."""
    n = len(a)
    main = a * a - value * value
    main[1:] += b * b
    off = a[:-1] * b
    low, mid, up, two, y = off.copy(), main.copy(), np.append(off, 0.0), np.zeros(n), x.copy()
    tiny = EPS * max(np.abs(main).max(), 1e-300)
    for k in range(n - 1):
        if abs(low[k]) > abs(mid[k]):
            mid[k], low[k] = low[k], mid[k]
            up[k], mid[k + 1] = mid[k + 1], up[k]
            two[k], up[k + 1] = up[k + 1], 0.0
            y[k], y[k + 1] = y[k + 1], y[k]
        if not mid[k]:
            mid[k] = tiny
        f = low[k] / mid[k]
        mid[k + 1] -= f * up[k]
        up[k + 1] -= f * two[k]
        y[k + 1] -= f * y[k]
    for k in range(n - 1, -1, -1):
        y[k] -= (up[k] * y[k + 1] if k + 1 < n else 0.0) + (two[k] * y[k + 2] if k + 2 < n else 0.0)
        y[k] /= mid[k] if mid[k] else tiny
        if abs(y[k]) > 1e200:
            y /= 1e200
    return y / math.sqrt(y @ y)


# On Spark


@dataclass
class Whitening:
    """Directions (columns) with eigenvalues of the covariance, falling, over ``n`` rows with the given sums."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows."""
        return self.centred(x) @ self.directions / np.sqrt(self.values)


def whole_numbers(vectors) -> np.ndarray:
    return np.floor(SCALE * np.stack(vectors).astype(np.float64)).astype(np.int64) + SHIFT


def sound_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that count, of one length."""
    own_id, vector = (F.col(c) for c in quoted(id_col, vector_col))
    vector = vector.cast("array<double>")
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = vectors.select(own_id.alias("id"), F.when(good, vector).alias("vector")).where("vector IS NOT NULL")
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("vector") == (lengths["d"] if lengths else 0))


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of (vector) rows of one length; None without rows or without variance."""

    def add(frames):
        n, sums = 0, 0
        for frame in frames:
            if len(frame):
                n, sums = n + len(frame), sums + whole_numbers(frame["vector"]).astype(object).sum(axis=0)
        if n:
            yield pd.DataFrame({"n": [n], "sums": [[str(s) for s in sums]]})

    parts = rows.select("vector").mapInPandas(lean(add), "n long, sums array<string>")
    spread = parts.select("n", F.posexplode("sums").alias("at", "part")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    told = spread.orderBy("at").collect()  # one row for each dimension
    if not told:
        return None
    n, sums, d = told[0]["n"], [int(r["total"]) for r in told], len(told)
    mean = np.array([s / n for s in sums])

    def reduce(frames):
        r = np.zeros((0, d))
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                r = triangle(np.vstack([r, whole_numbers(frame["vector"].iloc[at : at + BLOCK]) - mean]))
        if len(r):
            yield pd.DataFrame({"node": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        r = triangle(np.vstack([x.reshape(d, d) for x in frame["r"]]))
        return pd.DataFrame({"node": frame["node"].iloc[:1] // FAN_IN, "r": [r.ravel()]})

    level = materialise(rows.select("vector").mapInPandas(lean(reduce), "node long, r array<double>"), "triangles", 64)
    width = (level.agg(F.max("node")).first()[0] or 0) + 1
    while width > 1:
        level = level.groupBy(F.floor(F.col("node") / FAN_IN).alias("over")).applyInPandas(join, "node long, r array<double>")
        width = math.ceil(width / FAN_IN)
    r = np.array(level.first()["r"]).reshape(d, d)
    trace = float((r * r).sum()) / n
    a, b, right = bidiagonal(r)
    values, z = right_vectors(a, b, components)
    if not len(values):
        return None
    v = carried_back(z, right)
    v /= np.sqrt((v * v).sum(axis=0))
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, values**2 / n, v, trace)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)

    def products(frames):
        gram, sums, any_ = np.zeros((k, k)), np.zeros(k), False
        for frame in frames:
            if len(frame):
                w, any_ = model(whole_numbers(frame["vector"])), True
                gram, sums = gram + w.T @ w, sums + w.sum(axis=0)
        if any_:
            yield pd.DataFrame({"node": [TaskContext.get().partitionId()], "m": [np.concatenate([gram.ravel(), sums])]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": frame["node"].iloc[:1] // FAN_IN, "m": [np.sum(list(frame.sort_values("node")["m"]), axis=0)]})

    level = materialise(rows.select("vector").mapInPandas(lean(products), "node long, m array<double>"), "products", 64)
    width = level.agg(F.max("node")).first()[0] + 1
    while width > 1:
        level = level.groupBy(F.floor(F.col("node") / FAN_IN).alias("over")).applyInPandas(add, "node long, m array<double>")
        width = math.ceil(width / FAN_IN)
    m = np.array(level.first()["m"])
    mean = m[k * k :] / model.n  # zero but for rounding, as the rows are centred before
    return float(np.abs(m[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    rows = materialise(sound_rows(vectors, id_col, vector_col), "sound", 10_000)
    model = fit(rows, components)
    error = identity_error(rows, model) if model else 0.0
    sums = np.array(model.sums, object) if model else None

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(vectors: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"deviation": pd.array([None] * len(vectors), "Int64"), "whitened": [[]] * len(vectors)})
        x = whole_numbers(vectors)
        return pd.DataFrame({"deviation": pd.array(_squares(x, model.n, sums), "Int64"), "whitened": list(model(x))})

    told = rows.select("id", project("vector").alias("p")).select("id", "p.deviation", F.posexplode("p.whitened").alias("at", "whitened"))
    shares = F.array(*(F.lit(float(v)) for v in (model.values / model.trace if model else [0.0])))
    return told.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S)**2 for each row; None beyond 64 bits."""
    about = ((x - (sums / n).astype(float)) ** 2).sum(axis=1) * float(n) ** 2
    if about.max(initial=0.0) < 2.0**62 and np.abs(x).max() * float(n) < 2.0**62 and max(abs(int(s)) for s in sums) < 1 << 62:
        off = n * x - sums.astype(np.int64)
        return (off * off).sum(axis=1).tolist()
    out = [int(v) for v in ((n * x.astype(object) - sums) ** 2).sum(axis=1)]
    return [v if v < 1 << 63 else None for v in out]
