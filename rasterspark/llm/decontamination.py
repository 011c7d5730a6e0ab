"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and freed of ASCII punctuation.  A document and a
benchmark item are compared if they share ``seed_words`` words in a row (all
words of an item that has fewer).  ``tile`` then marks the longest
non-overlapping common runs, longest first, by running Karp-Rabin matching; the
share of an item's words that some tile covers is its coverage, whatever the
order of the passages in the document.

Items are cut into seeds by a Spark job.  One scan of the documents keeps those
that hold a seed, by a bit table of 2 ** ``filter_bits`` bits (8 MB by default,
whatever the size of the benchmark; a fuller table only lets more through), and a
join on each item's rarest seeds gives the pairs to tile (``_rare``).  Documents of equal text are tiled
once.  Neither benchmark nor documents pass through the driver.

Null or empty documents and items match nothing.  Items that repeat id and text
count once; an id with several texts has an entry for each that matches.  Tiles
of one length are marked in the order of their places in the document, then in
the item.  Rows that repeat have one result each.  Texts of any length are
whole.  Empty tables give no overlap.  Other columns, of whatever name, pass
through; a column of the name ``out`` is replaced.
"""

from __future__ import annotations

import heapq
import string

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeHash, free_names, in_slices, lean, materialise, quoted, with_output

_PLAIN = bytes(32 if chr(c) in string.punctuation else c for c in range(256))
MATCHES = "array<struct<item: string, coverage: double, tiles: array<struct<doc_start: int, item_start: int, length: int>>>>"


def words_of(text: str) -> np.ndarray:
    """One hash per word of a text."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().encode().translate(_PLAIN).split()), np.uint64)


def tile(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (text start, pattern start, length), longest tiles first.

    At search length s, runs of s unmarked words of the text are looked up
    among those of the pattern by a rolling hash and then extended; a run of
    more than twice s raises s, and when no run of s is left s is halved.
    """
    base, modulus = 1_000_003, (1 << 61) - 1
    used_p, used_t, tiles = [False] * len(pattern), [False] * len(text), []

    def hashes(words, used, s):
        top, h, run = pow(base, s, modulus), 0, 0
        for k, w in enumerate(words):
            run = 0 if used[k] else run + 1
            h = (h * base + w) % modulus
            if k >= s:
                h = (h - words[k - s] * top) % modulus
            if run >= s:
                yield k - s + 1, h

    s = len(pattern)
    while s >= least:
        places: dict[int, list[int]] = {}
        for p, h in hashes(pattern, used_p, s):
            places.setdefault(h, []).append(p)
        found, longest, past = [], 0, {}
        for t, h in hashes(text, used_t, s) if places else ():
            for p in places.get(h, ()):
                if past.get(t - p, 0) > t:  # inside a run found before
                    continue
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                    n += 1
                if n >= s:
                    found.append((n, t, p))
                    past[t - p] = t + n
                    longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        heap = [(-n, t, p) for n, t, p in found]
        heapq.heapify(heap)
        while heap:
            n, t, p = heapq.heappop(heap)
            free = [not used_t[t + k] and not used_p[p + k] for k in range(-n)] + [False]
            if all(free[:-1]):
                used_t[t : t - n] = used_p[p : p - n] = [True] * -n
                tiles.append((t, p, -n))
                continue
            start = None
            for k, f in enumerate(free):  # what longer tiles left of this run competes by its own length
                if f and start is None:
                    start = k
                elif not f and start is not None:
                    if k - start >= s:
                        heapq.heappush(heap, (start - k, t + start, p + start))
                    start = None
        if s == least:
            break
        s = max(s // 2, least)
    return tiles


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(*quoted(text_col)).cast("string"), F.lit(""))


def _keys(text_col: str) -> list[Column]:
    """Two independent hashes that stand for a text."""
    return [F.xxhash64(_text(text_col)), F.xxhash64(F.lit(1), _text(text_col))]


def seeded(items: DataFrame, seed_words: int, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_key, item, n_words, width, words, seeds): distinct items with their word hashes and seeds (seed, times)."""

    def each(pdf):
        for key, item, text in zip(pdf["item_key"], pdf["item"], pdf["text"], strict=True):
            words = words_of(text)
            if len(words):
                width = min(seed_words, len(words))
                seeds, times = np.unique(RangeHash(words, 31).all(width).view(np.int64), return_counts=True)
                yield key, item, len(words), width, words.tobytes(), [{"seed": int(s), "times": int(n)} for s, n in zip(seeds, times, strict=True)]

    def run(frames):
        for pdf in frames:
            yield from in_slices(each(pdf), ["item_key", "item", "n_words", "width", "words", "seeds"], lambda row: 50 * len(row[5]))

    slim = items.select(F.col(*quoted(item_id)).cast("string").alias("item"), F.col(*quoted(item_text)).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    return slim.select(F.xxhash64("item", "text").alias("item_key"), "item", "text").mapInPandas(lean(run), "item_key long, item string, n_words int, width int, words binary, seeds array<struct<seed: long, times: int>>")


def _bit_table(seeds: DataFrame, bits: int) -> np.ndarray:
    """A table with two bits set for each seed, by its first and its next ``bits`` bits; at most 2 ** bits / 64 rows reach the driver."""
    place = F.explode(F.array(F.shiftrightunsigned("seed", 64 - bits), F.shiftrightunsigned(F.shiftleft("seed", bits), 64 - bits))).alias("place")
    rows = seeds.select(place).select(F.shiftright("place", 6).alias("slot"), (F.col("place") % 64).cast("int").alias("bit")).groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["slot"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def _in_table(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes with both bits set."""
    at = np.arange(len(h))
    for shifted in (0, bits):
        place = h[at] << np.uint64(shifted) >> np.uint64(64 - bits)
        at = at[(table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def _scan(docs: DataFrame, text_col: str, seeds: DataFrame, widths: list[int], bits: int) -> DataFrame:
    """(key1, key2, seeds, words, origins) of each text with a seed: its seeds, and the words around them with their places."""
    held = docs.sparkSession.sparkContext.broadcast(_bit_table(seeds, bits))

    def each(pdf, table):
        for key1, key2, text in zip(pdf["key1"], pdf["key2"], pdf["text"], strict=True):
            words = words_of(text)
            near, found = np.zeros(len(words) + 1, np.int32), []
            for width in widths:
                if len(words) < width:
                    continue
                h = RangeHash(words, 31).all(width)
                at = _in_table(table, h, bits)
                near[at] += 1
                near[at + width] -= 1
                found.append(h[at])
            if any(len(x) for x in found):
                origins = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                yield key1, key2, np.unique(np.concatenate(found)).view(np.int64), words[origins].tobytes(), origins.astype(np.int32).tobytes()

    def run(frames):
        for pdf in frames:
            yield from in_slices(each(pdf, held.value), ["key1", "key2", "seeds", "words", "origins"], lambda row: 20 * len(row[2]) + len(row[3]))

    slim = docs.select(*[k.alias(n) for k, n in zip(_keys(text_col), ("key1", "key2"), strict=True)], _text(text_col).alias("text"))
    found = slim.mapInPandas(lean(run), "key1 long, key2 long, seeds array<long>, words binary, origins binary")
    return found.groupBy("key1", "key2").agg(*[F.first(c).alias(c) for c in ("seeds", "words", "origins")])


def _needed(threshold: float) -> Column:
    """Seeds that a text must share with an item: a tile of n words has n - width + 1 seeds, n / width at least."""
    return F.ceil((threshold * F.col("n_words") - 1e-9) / F.col("width"))


def _rare(seeds: DataFrame, threshold: float) -> DataFrame:
    """(item_key, seed): the seeds of each item, those of fewest items first, of which a text must hold one.

    A text that holds only seeds behind these shares fewer than are needed, so
    phrases that many items have bring no pairs of their own.
    """
    often = seeds.groupBy("seed").agg(F.count("*").alias("often"))
    item = Window.partitionBy("item_key")
    before = F.coalesce(F.sum("times").over(item.orderBy("often", "seed").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = seeds.join(often, "seed").select("item_key", "seed", before.alias("before"), (F.sum("times").over(item) - _needed(threshold)).alias("spare"))
    return ranked.where("before <= spare").select("item_key", "seed")


def _tiled(pairs: DataFrame, seed_words: int) -> DataFrame:
    """(key1, key2, item, coverage, tiles) of pairs with the words of both sides that share the ``needed`` seeds."""

    def each(pdf):
        for key1, key2, item, pattern, words, origins, seeds, width, needed in zip(*(pdf[c] for c in ("key1", "key2", "item", "item_words", "words", "origins", "seeds", "width", "needed")), strict=True):
            pattern = np.frombuffer(pattern, np.uint64)
            if np.isin(RangeHash(pattern, 31).all(width).view(np.int64), seeds).sum() < needed:
                continue
            pattern, words, origins = pattern.tolist(), np.frombuffer(words, np.uint64).tolist(), np.frombuffer(origins, np.int32).tolist()
            text, origin = [], []
            for k, place in enumerate(origins):
                if k and place != origins[k - 1] + 1:
                    text.append(-1), origin.append(-1)  # no word equals this one
                text.append(words[k]), origin.append(place)
            tiles = tile(pattern, text, min(seed_words, len(pattern)))
            yield key1, key2, item, sum(n for _, _, n in tiles) / len(pattern), [{"doc_start": origin[t], "item_start": p, "length": n} for t, p, n in tiles]

    def run(frames):
        for pdf in frames:
            yield from in_slices(each(pdf), ["key1", "key2", "item", "coverage", "tiles"], lambda row: 50 * len(row[4]) + 100)

    return pairs.mapInPandas(lean(run), "key1 long, key2 long, item string, coverage double, tiles array<struct<doc_start: int, item_start: int, length: int>>")


def overlapping_texts(docs: DataFrame, items: DataFrame, threshold: float = 0.5, seed_words: int = 5, filter_bits: int = 26, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key1, key2, matches): the texts, by two hashes, of which some item's coverage reaches ``threshold``."""
    known = materialise(seeded(items, seed_words, item_id, item_text), "items")
    seeds = known.select("item_key", "n_words", "width", F.explode("seeds").alias("s")).select("item_key", "n_words", "width", "s.seed", "s.times")
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # seed_words values at most
    held = materialise(_scan(docs, text_col, seeds, widths, filter_bits), "seeded")
    pairs = held.select("key1", "key2", F.explode("seeds").alias("seed")).join(_rare(seeds, threshold), "seed").select("key1", "key2", "item_key").distinct()
    items_of = known.select("item_key", "item", "width", _needed(threshold).alias("needed"), F.col("words").alias("item_words"))
    pairs = pairs.join(held, ["key1", "key2"]).join(items_of, "item_key")
    found = _tiled(pairs, seed_words).where(F.col("coverage") >= threshold)
    return materialise(found.groupBy("key1", "key2").agg(F.array_sort(F.collect_list(F.struct("item", "coverage", "tiles"))).alias("matches")), "overlaps")


def find_overlaps(docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "overlaps", **options) -> DataFrame:
    """``docs`` plus ``out``: the items whose coverage reaches the threshold, with their tiles."""
    key1, key2, matches = free_names(docs, "key1", "key2", "matches")
    found = overlapping_texts(docs, items, text_col=text_col, **options).toDF(key1, key2, matches)
    keyed = docs.withColumns(dict(zip((key1, key2), _keys(text_col), strict=True)))
    joined = keyed.join(found, [key1, key2], "left")
    return joined.select(*with_output(docs, {out: F.coalesce(F.col(matches), F.expr(f"CAST(array() AS {MATCHES})"))}))


def without_overlaps(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which no item's coverage reaches the threshold."""
    key1, key2 = free_names(docs, "key1", "key2")
    found = overlapping_texts(docs, items, text_col=text_col, **options).select(F.col("key1").alias(key1), F.col("key2").alias(key2))
    keyed = docs.withColumns(dict(zip((key1, key2), _keys(text_col), strict=True)))
    return keyed.join(found, [key1, key2], "left_anti").select(*quoted(*docs.columns))
