"""Suffix-array dedup: longest-previous-factor arrays over byte strings.

A byte is removed if a string of ``window`` bytes around it also starts earlier
(smaller id, or same document and earlier start).  ``longest_previous`` sorts
the suffixes of a text, finds for each the previous and next smaller positions
in suffix order, and so its longest earlier match.

A corpus has no single suffix array: windows are dealt out by their least gram
(``repeats.cut``), so that equal windows meet in one bucket.  Segments of equal
bytes are merged first and only their first copy stays; each bucket's distinct
segments then get one suffix array, in document order.  A bucket of more than
``crowded`` segments (a passage that many documents hold in surroundings of
their own) would burden one task: its windows are dealt out once more, by two
64-bit hashes of each whole window, and equal hashes count as equal windows.

Null id: after all others.  Null or empty text: nothing to remove.  Texts of
any length are whole.  Rows that repeat an id are told apart by text; rows that
repeat both have one result each.  An empty table gives no rows.  Other columns,
of whatever name, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, in_slices, lean, materialise, whole_groups
from .repeats import SPAN, covered, cut, fetch, later_windows, marked, packed, rows_of, runs_of, start_n, unpack, windows_of, with_spans

#: Bytes of the buckets that share a suffix array (a larger bucket has its own).
TOGETHER = 1 << 17

#: Parts strings of one suffix array; UTF-8 has no such byte.
PARTING = b"\xff"


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1."""
    before = np.arange(len(values)) - 1
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        open_ = open_[values[before[open_]] > values[open_]]
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return before


def longest_previous(text: np.ndarray, cap: int = 128, places: np.ndarray | None = None) -> np.ndarray:
    """Longest-previous-factor array of bytes, capped at ``cap`` (at least 8).

    Entry k is the length of the longest prefix of the suffix at place k that
    also starts at a smaller place.  ``places`` (ascending) may name the only
    places that count.  Suffixes are sorted by ranks of 8 bytes, then of several
    such ranks in a row, and so on, as many as fit into 64 bits.
    """
    n = len(text)
    places = np.arange(n) if places is None else places
    if not len(places):
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 2 * cap + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    bits = int(n + 1).bit_length()
    fit, width, levels = 64 // bits, 8, []

    def ranks_of(key):
        order = np.argsort(key)
        found = key[order]
        ranks = np.zeros(n + 2 * cap + 8, np.uint32)
        ranks[order] = np.cumsum(np.r_[True, found[1:] != found[:-1]], dtype=np.uint32)
        return ranks

    def joined(at, offsets):
        key = np.zeros(len(at), np.uint64)
        for o in offsets:
            key = key << np.uint64(bits) | ranks[at + o]
        return key

    ranks = ranks_of(key)
    levels.append((width, ranks))
    everywhere = np.arange(n)
    while width * fit < cap:
        ranks = ranks_of(joined(everywhere, range(0, width * fit, width)))
        width *= fit
        levels.append((width, ranks))
    key = joined(places, [*range(0, cap - width, width), cap - width])
    order = np.argsort(key)
    key = key[order]
    lpf = np.zeros(len(places), np.int64)
    for order, key in ((order, key), (order[::-1], key[::-1])):  # previous, then next smaller places in suffix order
        near = _nearest_smaller(order)
        some = np.flatnonzero(near >= 0)
        mine, length = order[some], np.full(len(some), cap)
        short = np.flatnonzero(key[some] != key[near[some]])
        a, b, found = places[mine[short]], places[order[near[some[short]]]], np.zeros(len(short), np.int64)
        for width, ranks in [*levels[::-1], (1, padded)]:
            for _ in range(fit if width > 1 else 7):
                found += width * (ranks[a + found] == ranks[b + found])
            found = np.minimum(found, cap - 1)
        length[short] = found
        lpf[mine] = np.maximum(lpf[mine], length)
    return lpf


def _split(pdf: pd.DataFrame, at: np.ndarray):
    bounds = [0, *at, len(pdf)]
    return (pdf.iloc[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def repeated_windows(texts: DataFrame, window: int, gram: int, crowded: int) -> DataFrame:
    """SPAN rows: the windows (start, n in a row) of each packed document that also start earlier."""
    kept = marked(cut(texts, "byte", window, gram)).where("copy OR open").drop("first_id", "first_tie", "first_place")
    parted = materialise(kept, "segments", 8192)

    def parts(pdf):
        for i, tie, z, wanted in zip(pdf["id"], pdf["tie"], pdf["packed"], pdf["wanted"], strict=True):
            raw = unpack(z)
            for w in wanted:
                p = w["place"]
                yield w["route"], i, tie, p, raw[p >> 32 : (p >> 32) + (p >> 1 & 0x7FFFFFFF) + window - 1]

    def cut_out(frames):
        for pdf in frames:
            yield from in_slices(parts(pdf), ["route", "id", "tie", "place", "part"], lambda row: len(row[4]) + 100)

    def compare(frames):
        for pdf in whole_groups(frames, ["route"]):
            pdf = pdf.drop_duplicates(["route", "id", "tie", "place"], ignore_index=True)
            route, length = pdf["route"].to_numpy(), pdf["part"].str.len().to_numpy()
            new = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
            before = np.r_[0, np.cumsum(length)[new[1:] - 1]] // TOGETHER
            for rows in _split(pdf, new[1:][before[1:] != before[:-1]]):  # whole buckets
                text = np.frombuffer(PARTING.join(rows["part"]) + PARTING, np.uint8)
                starts = np.r_[0, np.cumsum(rows["part"].str.len().to_numpy() + 1)[:-1]]
                n = (rows["place"].to_numpy() >> 1) & 0x7FFFFFFF
                before_ = np.cumsum(n) - n
                places = np.repeat(starts - before_, n) + np.arange(n.sum())  # the starts of whole windows
                found = np.zeros(len(text), bool)
                found[places] = longest_previous(text, window, places) >= window
                spans = runs_of(found)
                if len(spans):
                    at = np.searchsorted(starts, spans[:, 0], "right") - 1
                    yield pd.DataFrame({"id": rows["id"].to_numpy()[at], "tie": rows["tie"].to_numpy()[at], "start": (rows["place"].to_numpy()[at] >> 32) + spans[:, 0] - starts[at], "n": spans[:, 1] - spans[:, 0]})

    open_ = parted.where("open").select("route", "id", "tie", "place")
    crowds = materialise(open_.groupBy("route").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > crowded).select("route"), "crowds")
    few = fetch(texts, open_.join(crowds, "route", "left_anti")).mapInPandas(lean(cut_out), "route long, id long, tie long, place long, part binary")
    few = few.repartition("route").sortWithinPartitions("route", "id", "tie", "place").mapInPandas(lean(compare), SPAN)
    found = start_n(parted.where("copy")).unionByName(few)
    if crowds.limit(1).count():
        many = later_windows(windows_of(fetch(texts, open_.join(crowds, "route", "left_semi")), "byte", window))
        found = found.unionByName(many.select("id", "tie", "start", F.lit(1).alias("n")))
    return found


def suffix_dedup(docs: DataFrame, window: int = 100, gram: int = 32, crowded: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the bytes of later copies.

    Returns per row: the id column, ``kept`` (the remaining bytes, which may end
    inside a character), ``n_bytes``, and ``removed``, an array of [start, end)
    byte ranges.
    """
    texts = materialise(packed(rows_of(docs, id_col, text_col)), "texts")
    spans = materialise(repeated_windows(texts, window, gram, crowded), "spans", 8192)

    def told(pdf):
        for i, z, found in zip(pdf["id"], pdf["packed"], pdf["spans"], strict=True):
            raw = unpack(z)
            mask = covered(found, window, len(raw))
            yield i, np.frombuffer(raw, np.uint8)[~mask].tobytes(), len(raw), [{"start": int(a), "end": int(b)} for a, b in runs_of(mask)]

    def keep(frames):
        for pdf in frames:
            yield from in_slices(told(pdf), ["id", "kept", "n_bytes", "removed"], lambda row: len(row[1]) + 100)

    result = with_spans(texts, spans).mapInPandas(lean(keep), "id long, kept binary, n_bytes long, removed array<struct<start: long, end: long>>")
    return result.select(F.when(F.col("id") != F.lit(NO_ID), F.col("id")).alias(id_col), "kept", "n_bytes", "removed")
