"""Repeated windows of a corpus: what suffix-array and substring dedup share.

A document is a sequence of units (bytes or words).  ``cut`` turns documents
into segments: runs of windows with one key (see ``common.segments``).  Equal
windows have equal keys, so

* a segment whose key and content an earlier one has is a repeat as a whole;
* a segment whose key no other has holds nothing new to compare;
* the few others, with one key but different contents, are compared window by
  window, by the operator's own method.

Documents are ordered by (id, tie): ``tie`` tells apart different texts under
one id.  Segments of equal content near each other in one map partition are
merged before the shuffle, so a passage that every document holds costs a row
per half a million segments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, RangeHash, in_slices, lean, materialise, mix64, quoted, random_table, segments, whole_groups

DOC = "id long, tie long, packed binary"
#: place: start << 32 | n << 1 | repeats.  route: the key, or a spread-out hash for copies.
#: first_*: for copies, the row of equal content that comes first.
SEGMENT = "route long, content long, id long, tie long, place long, copy boolean, first_id long, first_tie long, first_place long"
MARKED = f"{SEGMENT}, open boolean"
SPAN = "id long, tie long, start int, n int"
#: A window of a document by two hashes, and where the first of its kind starts.
WINDOW = "route long, other long, id long, tie long, start int, copy boolean, first_id long, first_tie long, first_start int"


def byte_units(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


_BYTES = random_table(1)


def word_units(text: bytes) -> np.ndarray:
    """One hash per word; words are what white space (0x20, 0x09-0x0D) separates."""
    return word_hashes(text.split())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


UNITS = {"byte": byte_units, "word": word_units}


def repeats_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether an id (or null) has several rows."""
    return bool(docs.select(id_of(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def tie_of(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Tells texts under one id apart: a hash of the text, or 0 where no id has several rows."""
    return F.xxhash64(text_of(text_col)) if repeats_ids(docs, id_col) else F.lit(0).cast("long")


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(*quoted(text_col)).cast("string"), F.lit(""))


def id_of(id_col: str) -> Column:
    return F.coalesce(F.col(*quoted(id_col)).cast("long"), F.lit(NO_ID))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, text) of every row.  Null id: ``NO_ID``, after all others.  Null text: empty."""
    return docs.select(id_of(id_col).alias("id"), tie_of(docs, id_col, text_col).alias("tie"), text_of(text_col).alias("text"))


def packed(rows: DataFrame) -> DataFrame:
    """(id, tie, packed): each row's id, tie and compressed text."""

    def pack(frames):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "tie": pdf["tie"], "packed": [squeeze(t.encode()) for t in pdf["text"]]})

    return rows.mapInPandas(lean(pack), DOC)


def unpack(packed) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(packed))


def copies_of(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (*what, id, tie, start), ``what`` being two hashes, in order.

    Returns (order without repeated rows, whether each is a later copy of what
    an earlier one holds, whether it is the first with its first hash).
    """
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    same = [np.zeros(len(order), bool) for _ in range(3)]
    if len(order):
        for out, cols in zip(same, (sorted_[:1], sorted_[:2], sorted_), strict=True):
            out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
    once = ~same[2]
    return order[once], same[1][once], ~same[0][once]


def routed(first: np.ndarray, copy: np.ndarray, seed: int) -> np.ndarray:
    """Where each row goes: by its hash, copies anywhere, so that frequent ones spread."""
    anywhere = mix64(np.arange(len(first), dtype=np.uint64) + np.uint64(seed & 0xFFFFFFFF))
    return np.where(copy, anywhere, first).view(np.int64)


def cut(docs: DataFrame, unit: str, window: int, gram: int, batch: int = 1 << 17, merge: int = 1 << 17) -> DataFrame:
    """Segments of all packed documents; later copies among about ``merge`` segments in a row are marked ``copy``."""

    def merged(parts):
        columns = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order, copy, _ = copies_of(columns)
        key, content, ident, tie, place = (c[order] for c in columns)
        first = np.flatnonzero(~copy)[np.cumsum(~copy) - 1]
        source = [np.where(copy, c[first], 0) for c in (ident, tie, place)]
        route = routed(key, copy, int(ident[0]))
        for at in range(0, len(order), 100_000):
            w = slice(at, at + 100_000)
            yield pd.DataFrame({
                "route": route[w], "content": content[w].view(np.int64), "id": ident[w], "tie": tie[w], "place": place[w], "copy": copy[w],
                "first_id": source[0][w], "first_tie": source[1][w], "first_place": source[2][w],
            })

    def run(frames):
        units, parts, held = UNITS[unit], [], []
        ids: list[int] = []
        ties: list[int] = []

        def flush():
            if held:
                bounds = np.cumsum([0, *map(len, held)])
                d, start, n, key, content, repeats = segments(np.concatenate(held), bounds, window, gram)
                place = start.astype(np.int64) << 32 | n.astype(np.int64) << 1 | repeats
                parts.append((key, content, np.array(ids, np.int64)[d], np.array(ties, np.int64)[d], place))
                held.clear(), ids.clear(), ties.clear()
            return sum(len(p[0]) for p in parts)

        size = 0
        for pdf in frames:
            for i, tie, z in zip(pdf["id"], pdf["tie"], pdf["packed"], strict=True):
                u = units(unpack(z))
                if len(u) >= window:
                    held.append(u), ids.append(i), ties.append(tie)
                    size += len(u)
                    if size >= batch:
                        size = 0
                        if flush() >= merge:
                            yield from merged(parts)
        if flush():
            yield from merged(parts)

    return docs.mapInPandas(lean(run), SEGMENT)


def marked(cut_: DataFrame, tasks: int | None = None) -> DataFrame:
    """Segments with further copies marked, and in ``open`` the firsts that need comparing by window."""
    dealt = cut_.repartition(tasks, "route") if tasks else cut_.repartition("route")
    return dealt.sortWithinPartitions("route", "content", "id", "tie", "place").mapInPandas(lean(_mark), MARKED)


def _mark(frames):
    """Works through sorted segments; holds those of one content and one frame at most."""
    held, before = None, None
    for pdf in whole_groups(frames, ["route", "content"]):
        known = pdf["copy"].to_numpy()
        if known.any():
            yield pdf[known].assign(open=False)
        rest = pdf[~known]
        if len(rest):
            if held is not None:
                yield _judged(held, before, rest["route"].iat[0])
                before = held["route"].iat[-1]
            held = rest
    if held is not None:
        yield _judged(held, before, None)


def _judged(pdf: pd.DataFrame, before, after) -> pd.DataFrame:
    """``before`` and ``after`` are the routes that the segments around these have."""
    route, ident, tie, place = (pdf[c].to_numpy() for c in ("route", "id", "tie", "place"))
    same, repeated, of = _as_before(pdf, ("route", "content"), ("id", "tie", "place"))
    first = np.flatnonzero(~same)
    own = route[first]
    shared = np.zeros(len(first), bool)  # another content has the route
    shared[1:] |= own[1:] == own[:-1]
    shared[:-1] |= own[1:] == own[:-1]
    shared[0] |= before is not None and own[0] == before
    shared[-1] |= after is not None and own[-1] == after
    open_ = np.zeros(len(pdf), bool)
    open_[first] = shared | (place[first] & 1).astype(bool)
    out = pdf.assign(copy=same, open=open_, first_id=np.where(same, ident[of], 0), first_tie=np.where(same, tie[of], 0), first_place=np.where(same, place[of], 0))
    return out[~repeated]


def start_n(df: DataFrame) -> DataFrame:
    """(id, tie, start, n) of segments."""
    return df.select("id", "tie", F.shiftright("place", 32).cast("int").alias("start"), (F.shiftright("place", 1).bitwiseAND(0x7FFFFFFF)).cast("int").alias("n"))


def only(docs: DataFrame, wanted: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The documents whose (id, tie) is in ``wanted``, a materialised table with distinct ones.

    Up to ``most`` of them (16 bytes each) are broadcast, so that texts stay
    where they are; more are joined by a shuffle.
    """
    keys = wanted.select("id", "tie")
    return docs.join(F.broadcast(keys) if wanted.count() <= most else keys, ["id", "tie"], "left_semi")


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, tie, packed, wanted): documents with the array of their wanted segments."""
    per_doc = materialise(wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("route", "place")).alias("wanted")), "wanted", 4096)
    return only(docs, per_doc).join(per_doc, ["id", "tie"])


def wanted_parts(raw: bytes, wanted, unit: str, window: int):
    """(start, units) of the wanted segments, those next to each other as one; units elsewhere in the document are not looked at."""
    places = np.sort(np.array([w["place"] for w in wanted], np.int64))
    start, n = places >> 32, places >> 1 & 0x7FFFFFFF
    first = np.flatnonzero(np.r_[True, start[1:] > (start + n)[:-1]])
    whole = raw if unit == "byte" else raw.split()
    for a, b in zip(start[first].tolist(), np.maximum.reduceat(start + n, first).tolist(), strict=True):
        part = whole[a : b + window - 1]
        yield a, byte_units(part) if unit == "byte" else word_hashes(part)


def window_rows(parts: list, window: int) -> tuple[np.ndarray, ...]:
    """(hash, other hash, id, tie, start) of every window of the parts (id, tie, start, units)."""
    lengths = np.array([len(p[3]) for p in parts])
    units, ends = np.concatenate([p[3] for p in parts]), np.cumsum(lengths)
    owner = np.repeat(np.arange(len(parts)), lengths)[: max(0, len(units) - window + 1)]
    at = np.flatnonzero(np.arange(len(owner)) + window <= ends[owner])
    owner = owner[at]
    ids, ties, starts = (np.array([p[k] for p in parts], np.int64) for k in range(3))
    return *(RangeHash(units, seed).all(window).view(np.int64)[at] for seed in (21, 22)), ids[owner], ties[owner], starts[owner] + at - (ends - lengths)[owner]


def windows_of(fetched: DataFrame, unit: str, window: int, batch: int = 1 << 16, merge: int = 1 << 17) -> DataFrame:
    """WINDOW rows of the wanted segments of fetched documents; later copies among about ``merge`` rows are marked."""

    def merged(parts):
        columns = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order, copy, _ = copies_of(columns)
        a, b, ident, tie, start = (c[order] for c in columns)
        first = np.flatnonzero(~copy)[np.cumsum(~copy) - 1]
        route = routed(a.view(np.uint64), copy, int(ident[0]))
        for at in range(0, len(order), 100_000):
            w = slice(at, at + 100_000)
            yield pd.DataFrame({"route": route[w], "other": b[w], "id": ident[w], "tie": tie[w], "start": start[w], "copy": copy[w], "first_id": ident[first][w], "first_tie": tie[first][w], "first_start": start[first][w]})

    def run(frames):
        held, parts, n_units, n_rows = [], [], 0, 0
        for pdf in frames:
            for i, tie, z, wanted in zip(pdf["id"], pdf["tie"], pdf["packed"], pdf["wanted"], strict=True):
                for start, units in wanted_parts(unpack(z), wanted, unit, window):
                    held.append((i, tie, start, units))
                    n_units += len(units)
                if n_units >= batch:
                    parts.append(window_rows(held, window))
                    held, n_units, n_rows = [], 0, n_rows + len(parts[-1][0])
                if n_rows >= merge:
                    n_rows = 0
                    yield from merged(parts)
        if held:
            parts.append(window_rows(held, window))
        if parts:
            yield from merged(parts)

    return fetched.mapInPandas(lean(run), WINDOW)


def later_windows(windows: DataFrame) -> DataFrame:
    """Of WINDOW rows those of which an earlier place holds an equal one."""

    def run(frames):
        for pdf in whole_groups(frames, ["route", "other"]):
            known = pdf["copy"].to_numpy()
            if known.any():
                yield pdf[known]
            rest = pdf[~known]
            if len(rest):
                same, repeated, of = _as_before(rest, ("route", "other"), ("id", "tie", "start"))
                out = rest.assign(copy=same, first_id=rest["id"].to_numpy()[of], first_tie=rest["tie"].to_numpy()[of], first_start=rest["start"].to_numpy()[of])
                yield out[same & ~repeated]

    return windows.repartition("route").sortWithinPartitions("route", "other", "id", "tie", "start").mapInPandas(lean(run), WINDOW)


def _as_before(pdf: pd.DataFrame, what: tuple, where: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted rows: equal to the row before in ``what``; also in ``where``; place of the first row of that ``what``."""
    as_last = lambda names: np.logical_and.reduce([np.r_[False, c[1:] == c[:-1]] for c in (pdf[n].to_numpy() for n in names)])
    same = as_last(what)
    return same, same & as_last(where), np.flatnonzero(~same)[np.cumsum(~same) - 1]


def covered(spans, window: int, length: int) -> np.ndarray:
    """Mask of the units that the windows of some (start, n) cover."""
    steps = np.zeros(length + 1, np.int64)
    if spans is not None and len(spans):
        starts = np.array([s["start"] for s in spans])
        ends = starts + np.array([s["n"] for s in spans]) + window - 1
        np.add.at(steps, starts, 1)
        np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def runs_of(mask: np.ndarray) -> np.ndarray:
    """[start, end) of the maximal runs of a mask, one row each."""
    return np.flatnonzero(np.diff(np.r_[False, mask, False])).reshape(-1, 2)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document with the array ``spans`` of its removed windows (null: none)."""
    per_doc = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return docs.join(per_doc, ["id", "tie"], "left")
