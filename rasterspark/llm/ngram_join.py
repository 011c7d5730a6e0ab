"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of ``gram``-word shingles (a shorter text is one shingle).  Rows
with one set form a class.  Classes that share a band of their MinHash values
are compared hash by hash, ``step`` at a time: with m equal values of n, and
every similarity equally likely beforehand, the chance that the similarity
reaches the threshold is P(Binomial(n + 1, threshold) <= m); a pair is dropped
as soon as that falls below ``tolerance``.  What is left joins classes into
clusters; within each, pairs that again survive the pruning are verified on the
whole shingle sets.  With 24 bands of 4 values a pair at 0.8 is missed with a
chance of 3 in a million.

All comparing runs in blocks of at most two chunks of a group (``in_chunks``):
no pair leaves its block, only counts and a spanning forest do.

Null or empty text: no shingle, no link.  Null id: sorts after all others and
stays null.  Repeated rows are rows of one class and link with each other.  Of
rows with one id the text decides which comes first.  Texts of any length are
whole.  An empty table gives no rows.  Other columns, of whatever name, are not
read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, RangeHash, free_names, in_slices, lean, materialise, quoted, random_table, whole_groups
from .links import by_block, components, in_chunks, local_forest, with_figures
from .repeats import id_of, only, packed, repeats_ids, rows_of, tie_of, unpack, word_units

BANDS, BAND_ROWS = 24, 4
HASHES = BANDS * BAND_ROWS
SIGNED = "id long, tie long, node long, signature binary, bands array<long>"


def shingles(raw: bytes, gram: int) -> np.ndarray:
    """Sorted distinct hashes of the ``gram``-word shingles of a text."""
    units = word_units(raw)
    if not len(units):
        return units
    return np.unique(RangeHash(units, 41).all(min(gram, len(units))))


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()) | 1).astype(np.int64)) if len(found) else 0


def minhashes(found: np.ndarray) -> np.ndarray:
    multipliers = random_table(42, HASHES)
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            part = found[at : at + 2048, None] * multipliers
            part ^= part >> np.uint64(29)
            low = np.minimum(low, (part * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return low


def sign(rows: DataFrame, gram: int) -> DataFrame:
    """(id, tie, node, signature, bands) of every row; a signature has one byte per MinHash value."""

    def signed(pdf):
        for i, tie, text in zip(pdf["id"], pdf["tie"], pdf["text"], strict=True):
            found = shingles(text.encode(), gram)
            if not len(found):
                yield i, tie, 0, b"", []
                continue
            low = minhashes(found)
            band = RangeHash(low, 43)(np.arange(0, HASHES, BAND_ROWS), np.arange(BAND_ROWS, HASHES + 1, BAND_ROWS)) + np.arange(BANDS, dtype=np.uint64)
            yield i, tie, node_of(found), (low >> np.uint64(13)).astype(np.uint8).tobytes(), band.view(np.int64)

    def run(frames):
        for pdf in frames:
            yield from in_slices(signed(pdf), ["id", "tie", "node", "signature", "bands"], lambda row: 1000)

    return rows.mapInPandas(lean(run), SIGNED)


def least_matches(threshold: float, tolerance: float, step: int) -> list[tuple[int, int]]:
    """(n, m): with fewer than m equal values of the first n, a pair is dropped."""
    out = []
    for n in range(step, HASHES + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def prune(a: np.ndarray, b: np.ndarray, rule: list[tuple[int, int]], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature arrays that no step of the rule drops."""
    left, right, before = [], [], 0
    for at in range(0, len(a), 64):  # first step on whole blocks, the others on what is left
        n, m = rule[0]
        equal = (a[at : at + 64, None, :n] == b[None, :, :n]).sum(axis=2)
        i, j = np.nonzero(equal >= m)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        equal = equal[i - at, j]
        for n, m in rule[1:]:
            before = n - (rule[1][0] - rule[0][0])
            equal = equal + (a[i, before:n] == b[j, before:n]).sum(axis=1)
            keep = equal >= m
            i, j, equal = i[keep], j[keep], equal[keep]
        left.append(i), right.append(j)
    return np.concatenate(left), np.concatenate(right)


def verify(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (i, j) of two lists of sets have a Jaccard similarity of at least ``threshold``."""
    if not len(i):
        return np.zeros(0, bool)
    rows, cols = np.unique(i), np.unique(j)
    size_a, size_b = np.array([len(a[k]) for k in rows]), np.array([len(b[k]) for k in cols])
    own_a, own_b = np.repeat(np.arange(len(rows)), size_a), np.repeat(np.arange(len(cols)), size_b)
    values, code = np.unique(np.concatenate([*(a[k] for k in rows), *(b[k] for k in cols)]), return_inverse=True)
    code_a, code_b = code[: len(own_a)], code[len(own_a) :]
    both = (np.bincount(code_a, minlength=len(values)) > 0) & (np.bincount(code_b, minlength=len(values)) > 0)
    dense = np.cumsum(both) - 1
    own_a, code_a, own_b, code_b = own_a[both[code_a]], dense[code_a[both[code_a]]], own_b[both[code_b]], dense[code_b[both[code_b]]]
    shared = np.zeros((len(rows), len(cols)), np.float32)
    order_a, order_b = np.argsort(code_a, kind="stable"), np.argsort(code_b, kind="stable")
    for at in range(0, int(both.sum()), 4096):
        part = []
        for own, code, order, n in ((own_a, code_a, order_a, len(rows)), (own_b, code_b, order_b, len(cols))):
            low, high = np.searchsorted(code[order], [at, at + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[own[order[low:high]], code[order[low:high]] - at] = 1
            part.append(m)
        shared += part[0] @ part[1].T
    r, c = np.searchsorted(rows, i), np.searchsorted(cols, j)
    common = shared[r, c].astype(np.float64)
    return common >= threshold * (size_a[r] + size_b[c] - common) - 1e-9


def jaccard_join(docs: DataFrame, threshold: float = 0.8, gram: int = 5, tolerance: float = 1e-6, step: int = 16, chunk: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_links``, ``component_id``, ``kept``, ``tie``.

    ``n_links`` counts the other rows at ``threshold`` or above; ``component_id``
    is the smallest id reachable by links; ``kept`` is true for one row of each
    component, the one with the smallest id (of repeated rows, all); ``tie`` tells texts
    under one id apart (see ``repeats.tie_of``).
    """
    rows = rows_of(docs, id_col, text_col)
    rule = least_matches(threshold, tolerance, step)
    signed = materialise(sign(rows, gram), "signed")
    classes = materialise(signed.where("node <> 0").groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("id", "tie")).alias("row"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "classes")
    signatures = classes.select("node", "signature")

    def pairs(block):
        sig = np.stack([np.frombuffer(x, np.uint8) for x in block["signature"]])
        a, b = np.flatnonzero(block["side"] != 1), np.flatnonzero(block["side"] != 0)
        i, j = prune(sig[a], sig[b], rule, bool((block["side"] == 2).all()))
        return a, b, i, j

    def candidates(frames):
        for group in whole_groups(frames, ["band", "left", "right"]):
            ends, nodes = [], []
            for _, block in group.groupby(["band", "left", "right"], sort=False):
                node = block["node"].to_numpy()
                a, b, i, j = pairs(block)
                low = local_forest(len(node), a[i], b[j])
                far = np.flatnonzero(low != np.arange(len(node)))
                ends.append(node[low[far]]), nodes.append(node[far])
            yield pd.DataFrame({"a": np.concatenate(ends), "b": np.concatenate(nodes)})

    members, tasks = in_chunks(classes.select(F.explode("bands").alias("band"), "node"), "band", "node", chunk)
    members = members.join(signatures, "node").select("band", "left", "right", "side", "node", "signature")
    edges = by_block(members, ["band", "left", "right"], tasks).mapInPandas(lean(candidates), "a long, b long")
    clusters = components(edges).select(F.col("id").alias("node"), F.col("component").alias("cluster"))

    def compare(frames):
        for group in whole_groups(frames, ["cluster", "left", "right"]):
            for _, block in group.groupby(["cluster", "left", "right"], sort=False):
                a, b, i, j = pairs(block)
                used = np.union1d(a[i], b[j])
                sets = dict(zip(used.tolist(), (shingles(unpack(block["packed"].iat[k]), gram) for k in used), strict=True))
                none = np.zeros(0, np.uint64)
                linked = verify([sets.get(k, none) for k in a.tolist()], [sets.get(k, none) for k in b.tolist()], i, j, threshold)
                i, j = a[i[linked]], b[j[linked]]
                node, copies = block["node"].to_numpy(), block["copies"].to_numpy()
                n = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                low = local_forest(len(node), i, j)
                some = np.flatnonzero(n > 0)
                if len(some):
                    yield pd.DataFrame({"a": node[low[some]], "b": node[some], "n": n[some].astype(np.int64)})

    whole = materialise(classes.select("node", "row.id", "row.tie", "copies", "signature").join(clusters, "node"), "clustered")
    # only texts of clustered classes are packed and moved; an id may have many texts, and a text many rows
    texts = packed(only(rows, whole)).groupBy("id", "tie").agg(F.first("packed").alias("packed"))
    blocks, tasks = in_chunks(whole.select("cluster", "node", "id", "tie", "copies", "signature"), "cluster", "node", 512, rows_a_task=2000)
    blocks = by_block(blocks.join(texts, ["id", "tie"]), ["cluster", "left", "right"], tasks)
    found = materialise(blocks.mapInPandas(lean(compare), "a long, b long, n long"), "links", 512)
    linked = found.groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.select("a", "b")).select(F.col("id").alias("node"), F.col("component").alias("group"))
    classes = classes.select("node", "copies", "row").join(linked, "node", "left").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = classes.groupBy("group").agg(F.min("row").alias("least"))
    classes = materialise(classes.join(least, "group").select("node", "copies", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "figures", 10_000)
    alone = F.struct("id", "tie")
    worded, bare = signed.select("id", "tie", "node").where("node <> 0"), signed.where("node = 0")
    out = with_figures(worded, classes, "node", "copies", worded.count()).select("id", "tie", "n_links", "least")
    out = out.unionByName(bare.select("id", "tie", F.lit(0).cast("long").alias("n_links"), alone.alias("least")))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(known("id").alias(id_col), "n_links", known("least.id").alias("component_id"), (alone == F.col("least")).alias("kept"), "tie")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component of the join; of rows without a shingle, one for each id and text.

    Columns of any name pass through.
    """
    ident, tie = free_names(docs, "row_id", "row_tie")
    kept = jaccard_join(docs, id_col=id_col, text_col=text_col, **options).where("kept")
    kept = kept.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias(ident), F.col("tie").alias(tie)).distinct()
    keyed = docs.withColumns({ident: id_of(id_col), tie: tie_of(docs, id_col, text_col)})
    if repeats_ids(docs, id_col):
        keyed = keyed.dropDuplicates([ident, tie])
    return keyed.join(kept, [ident, tie], "left_semi").select(*quoted(*docs.columns))
