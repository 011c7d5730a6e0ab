"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, and in how many documents.

Tokenizer A is a byte-level BPE (``tokenizers``) over space + text, B a BPE with
byte fallback (``sentencepiece``), which adds that space itself.  Places where
tokens of both end cut a text into groups; each A token of a group is linked with
each B token of it.

Both tokenizers start anew at a space behind a character that is no white space,
so a text is cut there into units, and a unit met before is not coded again
(``check_units`` proves the vocabulary's part of that once; texts for which it
does not hold are coded whole).  Then:

1. Every task aligns its documents and gives its own distinct pairs with their
   number of documents.
2. A minimal perfect hash is built over the distinct pairs, slice by slice: the
   keys that are alone at their place of a bit array leave, the others go on to
   the next array; a key's index is the number of set bits before its own.  The
   keys stand beside it by index, so a pair that is none of them is told.
3. The tasks' numbers are added into dense vectors by that index, and the vectors
   of a slice are summed in a tree of fan-in 16.
4. A second pass aligns the documents again and looks the pairs up.  Up to
   ``most_held`` pairs (29 bytes each) are broadcast; beyond that the pairs of
   most documents are, and the others, each of which few documents hold, meet
   their counts by a shuffle.

Null or empty text, and text whose joined A or B bytes are not its own: zeros and
no groups.  Texts of any length are whole; strings of special tokens are plain
text.  Every row is a document, repeated ones too.  Ids pass through whatever
their type.  An empty table gives no rows.  Other columns, of whatever name, are
not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, materialise, mix64, quoted

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Units longer than this are not remembered.
LONG_UNIT = 64
#: Units that a worker remembers.
REMEMBER = 500_000
#: A pair (a, b) is the number a << SHIFT | b.
SHIFT = 20
#: Units that are coded in a row.
RUN = 256
#: Links of a group that are listed one by one.
MOST_LINKS = 4096
#: Keys in a slice of the hash, partial counts of a task, vectors that a task sums.
SLICE, PARTIAL, FAN_IN = 32_768, 500_000, 16

#: A space behind a character that both tokenizers know as no white space.
CUT = re.compile(r"(?<=[!-~¡-ᙹᚁ-᠍᠏-῿‐-‧‰-⁞⁰-⿿、-퟿豈-﻾＀-￯\U00010000-\U0003ffff]) ")


def byte_table() -> dict[str, int]:
    """Byte by the character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Grown:
    """Rows that are added to at the end; memory doubles when it is full."""

    def __init__(self, *width: int):
        self.buffer, self.n = np.zeros((1024, *width), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.buffer):
            self.buffer = np.concatenate([self.buffer[: self.n], np.zeros((self.n + 2 * len(rows), *self.buffer.shape[1:]), np.int64)])
        self.buffer[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Aligner:
    """Units of texts with their tokens, groups and pairs; numbers them as they come."""

    def __init__(self, path_a: str, path_b: str, told: bool):
        self.told = told  # whether groups are wanted as text
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        table = byte_table()
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a: list[bytes] = [b""] * size
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            own = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
            self.bytes_a[k] = own
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in names]) for names in (self.bytes_a, self.bytes_b))
        self.marked = [f"{k}{mark}" for k in range(size) for mark in ",|"] + [f"{k}{mark}" for k in range(len(pieces)) for mark in ",;"]
        self.cuts = check_units(pieces)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []  # by number, like the rows of ``figures``
        self.figures = Grown(4)  # tokens of A and of B, groups, links
        self.ends = Grown()  # where the pairs of a number end, behind a 0
        self.ends.add(np.zeros(1, np.int64))
        self.pairs, self.times = Grown(), Grown()
        self.unsound: set[int] = set()
        self.characters = 0

    def units(self, text: str) -> list[str]:
        """The text, without the space before it, cut into units without theirs."""
        return CUT.split(text) if self.cuts else [text]

    def learn(self, units) -> None:
        """Code the units that have no number yet, all at a time."""
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if not new:
            return
        order, sound, *coded = self._coded(new, [(" " + u).encode() for u in new])
        first = len(self.groups)
        self.number.update(zip(map(new.__getitem__, order), range(first, first + len(new)), strict=True))
        self.unsound.update((first + np.flatnonzero(~np.array(sound, bool))).tolist())
        self.characters += sum(map(len, new))
        groups, figures, lengths, pairs, times = self._aligned(*coded)
        self.groups += groups
        self.figures.add(figures)
        self.ends.add(self.pairs.n + np.cumsum(lengths))
        self.pairs.add(pairs)
        self.times.add(times)

    def _coded(self, new: list[str], own: list[bytes]) -> tuple:
        """(order of the units, whether each is sound, ids of A behind each other, how many each has, the same of B).

        A unit is sound if the tokens of both join to its own bytes; others have
        no tokens.  Units after which a text may be cut are coded many in a row,
        and their tokens told apart by bytes; what does not fit is coded alone.
        """
        ends_well = [self.cuts and ("!" <= u[-1:] <= "~" or CUT.match(u[-1:] + " ", 1) is not None) for u in new]
        rows = [k for k, well in enumerate(ends_well) if well]
        alone = [k for k, well in enumerate(ends_well) if not well]
        chunks = [rows[k : k + RUN] for k in range(0, len(rows), RUN)]
        texts = [" " + " ".join([new[k] for k in chunk]) for chunk in chunks]
        coded = ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)) if chunks else ([], [])
        order, flat, counts = [], ([], []), ([], [])
        for chunk, *each in zip(chunks, *coded, strict=True):
            raw, ends, told = b"".join([own[k] for k in chunk]), np.cumsum([len(own[k]) for k in chunk]), []
            for found, names, sizes in zip(each, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b), strict=True):
                at = np.cumsum(sizes[found])
                to = np.searchsorted(at, ends)
                if b"".join([names[k] for k in found]) == raw and (at[np.minimum(to, len(at) - 1)] == ends).all():
                    told.append(np.diff(to, prepend=-1).tolist())
            if len(told) < 2:
                alone += chunk
                continue
            order += chunk
            for side in (0, 1):
                flat[side].extend(each[side])
                counts[side].extend(told[side])
        sound = [True] * len(order)
        if alone:
            a, b = self.a.encode_batch_fast([" " + new[k] for k in alone], add_special_tokens=False), self.b.encode([new[k] for k in alone], num_threads=1)
            for k, x, y in zip(alone, (e.ids for e in a), b, strict=True):
                fits = b"".join([self.bytes_a[i] for i in x]) == own[k] == b"".join([self.bytes_b[i] for i in y])
                order.append(k)
                sound.append(fits)
                for side, ids in enumerate((x, y) if fits else ([], [])):
                    flat[side].extend(ids)
                    counts[side].append(len(ids))
        return order, sound, *(np.array(x[side], np.int64) for side in (0, 1) for x in (flat, counts))

    def _aligned(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> tuple:
        """(groups as text, figures, number of pairs, pairs, how often each is linked) of units, which may have no tokens."""
        end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        to_a, to_b = np.searchsorted(end_a, cuts) + 1, np.searchsorted(end_b, cuts) + 1
        from_a, from_b = np.r_[0, to_a][:-1], np.r_[0, to_b][:-1]
        wide_a, wide_b = to_a - from_a, to_b - from_b
        unit = np.searchsorted(np.cumsum(n_a), to_a)  # of each group
        links = wide_a * wide_b
        figures = np.stack([n_a, n_b, np.bincount(unit, minlength=len(n_a)), np.zeros(len(n_a), np.int64)], axis=1)
        np.add.at(figures[:, 3], unit, links)
        # the groups as text: tokens in order, each with the mark that follows it
        groups = [""] * len(n_a)
        if self.told:
            place_a, place_b = np.arange(len(ids_a)) + np.repeat(from_b, wide_a), np.arange(len(ids_b)) + np.repeat(to_a, wide_b)
            code = np.zeros(len(ids_a) + len(ids_b), np.int64)
            code[place_a], code[place_b] = 2 * ids_a, 2 * (len(self.bytes_a) + ids_b)
            code[place_a[to_a - 1]] += 1
            code[place_b[to_b - 1]] += 1
            text, ends = list(map(self.marked.__getitem__, code.tolist())), np.cumsum(n_a + n_b).tolist()
            groups = ["".join(text[low:high])[:-1] for low, high in zip([0, *ends], ends, strict=False)]
        # each of a group's A tokens with each of its B tokens; of very large groups, each id pair once with its number
        small = links <= MOST_LINKS
        listed = np.where(small, links, 0)
        of = np.repeat(np.arange(len(links)), listed)
        within = np.arange(len(of)) - (np.cumsum(listed) - listed)[of]
        pairs = ids_a[from_a[of] + within // wide_b[of]] << SHIFT | ids_b[from_b[of] + within % wide_b[of]]
        owner, times = unit[of], np.ones(len(of), np.int64)
        for g in np.flatnonzero(~small).tolist():
            (x, m), (y, n) = (np.unique(ids, return_counts=True) for ids in (ids_a[from_a[g] : to_a[g]], ids_b[from_b[g] : to_b[g]]))
            pairs, times = np.r_[pairs, (x[:, None] << SHIFT | y).ravel()], np.r_[times, np.outer(m, n).ravel()]
            owner = np.r_[owner, np.full(len(x) * len(y), unit[g])]
        if not small.all():
            order = np.argsort(owner, kind="stable")
            pairs, times, owner = pairs[order], times[order], owner[order]
        return groups, figures, np.bincount(owner, minlength=len(n_a)), pairs, times

    def texts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers of all texts behind each other, how many each has); a text that is not aligned has none.

        Numbers of one call hold until the next, which may forget all units.
        """
        if len(self.groups) > REMEMBER or self.characters > 16 * REMEMBER:
            self.forget()
        split = [self.units(t) if t and "▁" not in t else [] for t in texts]
        self.learn(itertools.chain.from_iterable(split))
        numbers = [list(map(self.number.__getitem__, units)) for units in split]
        if self.unsound:
            for k in [k for k, own in enumerate(numbers) if not self.unsound.isdisjoint(own)]:
                self.learn([texts[k]])  # parts whose bytes differ may yet join to the text's own
                whole = self.number[texts[k]]
                numbers[k] = [] if whole in self.unsound else [whole]
        for u in [u for units in split for u in units if len(u) > LONG_UNIT]:
            self.number.pop(u, None)
        lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
        return np.fromiter(itertools.chain.from_iterable(numbers), np.int64, int(lengths.sum())), lengths

    def linked(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``used``, pair, how often) of the pairs of some units."""
        first = self.ends.buffer[used]
        n = self.ends.buffer[used + 1] - first
        owner = np.repeat(np.arange(len(used)), n)
        at = np.arange(len(owner)) + np.repeat(first - (np.cumsum(n) - n), n)
        return owner, self.pairs.buffer[at], self.times.buffer[at]


def check_units(pieces: list[str]) -> bool:
    """Whether no piece of B reaches from a character over the next space, so that units may be coded alone."""
    return not any("▁" in p.lstrip("▁") for p in pieces)


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str, told: bool) -> Aligner:
    """A worker's aligner; that of another pass goes."""
    return Aligner(path_a, path_b, told)


# Minimal perfect hash


def build_hash(keys: np.ndarray, gamma: float = 2.0) -> tuple[list[np.ndarray], np.ndarray]:
    """(bit arrays, keys by index) of distinct keys."""
    levels, rest, out = [], keys.astype(np.uint64), []
    while len(rest):
        size = max(8, math.ceil(gamma * len(rest)))
        at = _place(rest, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        out.append(rest[own][np.argsort(at[own])])
        levels.append(np.packbits(alone, bitorder="little"))
        levels[-1] = np.concatenate([np.array([size], np.uint32).view(np.uint8), levels[-1]])
        rest = rest[~own]
    return levels, (np.concatenate(out) if out else np.zeros(0, np.uint64)).astype(np.int64)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def slice_of(pairs: np.ndarray, slices: int) -> np.ndarray:
    return ((mix64(pairs.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) % np.uint64(slices)).astype(np.int32)


class PairHash:
    """Index of keys, from the bit arrays of one slice; -1 for any other number."""

    def __init__(self, levels: list[bytes], keys: np.ndarray):
        self.keys, self.bits, self.rank, before = keys, [], [], 0
        for level in levels:
            raw = np.frombuffer(level, np.uint8)
            bits = np.unpackbits(raw[4:], count=int(raw[:4].view(np.uint32)[0]), bitorder="little").astype(bool)
            self.bits.append(bits)
            self.rank.append((before + np.cumsum(bits) - 1).astype(np.int32))
            before += int(bits.sum())

    def index(self, pairs: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(pairs), -1, np.int64), np.arange(len(pairs))
        for level, (bits, rank) in enumerate(zip(self.bits, self.rank, strict=True)):
            if not len(open_):
                break
            at = _place(pairs[open_].astype(np.uint64), level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        known = out >= 0
        known[known] = self.keys[out[known]] == pairs[known]
        return np.where(known, out, -1)


class Counts:
    """Counts of pairs over all slices."""

    def __init__(self, rows: list[tuple[int, list[bytes], bytes, bytes]], slices: int):
        self.slices = slices
        self.held = {s: (PairHash(levels, np.frombuffer(keys, np.int64)), np.frombuffer(counts, np.int64)) for s, levels, keys, counts in rows}

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        """Count of each pair; 0 for one that is not held."""
        out, of = np.zeros(len(pairs), np.int64), slice_of(pairs, self.slices)
        for s in np.unique(of):
            if int(s) in self.held:
                at = np.flatnonzero(of == s)
                own, counts = self.held[int(s)]
                k = own.index(pairs[at])
                out[at] = np.where(k >= 0, counts[k], 0)
        return out


def partial_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n, task): documents of a task that hold the pair; a task gives a pair more than once when it has very many."""

    def count(frames):
        aligner, task = _aligner(path_a, path_b, False), TaskContext.get().partitionId()
        held: dict[int, int] = {}
        for frame in frames:
            numbers, lengths = aligner.texts(frame["text"].tolist())
            used, numbers = np.unique(numbers, return_inverse=True)
            owner, pairs, _ = aligner.linked(used)
            known, at = np.unique(pairs, return_inverse=True)
            start = np.searchsorted(owner, np.arange(len(used) + 1))
            once = np.unique(np.repeat(np.arange(len(lengths)), lengths) * max(1, len(used)) + numbers)  # each unit of a document once
            doc, unit = once // max(1, len(used)), once % max(1, len(used))
            n = (start[1:] - start[:-1])[unit]
            place = np.arange(int(n.sum())) + np.repeat(start[unit] - (np.cumsum(n) - n), n)
            each = np.unique(np.repeat(doc, n) * max(1, len(known)) + at[place])  # each pair of a document once
            times = np.bincount(each % max(1, len(known)), minlength=len(known))
            for pair, k in zip(known.tolist(), times.tolist(), strict=True):
                held[pair] = held.get(pair, 0) + k
            if len(held) > PARTIAL:
                yield pd.DataFrame({"pair": np.fromiter(held, np.int64, len(held)), "n": np.fromiter(held.values(), np.int64, len(held)), "task": np.int32(task)})
                held = {}
        if held:
            yield pd.DataFrame({"pair": np.fromiter(held, np.int64, len(held)), "n": np.fromiter(held.values(), np.int64, len(held)), "task": np.int32(task)})

    return docs.mapInPandas(lean(count), "pair long, n long, task int")


INDEX = "slice int, levels array<binary>, keys binary"


def hash_slices(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The minimal perfect hash of the distinct column ``pair``, one row a slice, and the number of slices."""
    slices = max(1, math.ceil(n / SLICE))

    def number(frames):
        for frame in frames:
            yield frame.assign(slice=slice_of(frame["pair"].to_numpy(), slices))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        levels, held = build_hash(np.sort(frame["pair"].to_numpy()))
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "levels": [[x.tobytes() for x in levels]], "keys": [held.tobytes()]})

    return keys.select("pair").mapInPandas(number, "pair long, slice int").groupBy("slice").applyInPandas(build, INDEX), slices


def summed_counts(partial: DataFrame, index: DataFrame, slices: int, rows: int) -> DataFrame:
    """(slice, counts): the dense vector of each slice, summed in a tree over the tasks."""
    branches = max(1, math.ceil(rows / slices / PARTIAL))

    def number(frames):
        for frame in frames:
            yield pd.DataFrame({"slice": slice_of(frame["pair"].to_numpy(), slices), "branch": (mix64(frame["task"].to_numpy().astype(np.uint64)) % np.uint64(branches)).astype(np.int32), "pair": frame["pair"], "n": frame["n"]})

    def dense(numbers: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(numbers):
            return pd.DataFrame({"slice": [], "branch": [], "counts": []})
        keys = np.frombuffer(own["keys"].iloc[0], np.int64)
        at = PairHash(own["levels"].iloc[0], keys).index(numbers["pair"].to_numpy())
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, numbers["n"].to_numpy())
        return pd.DataFrame({"slice": numbers["slice"].iloc[:1], "branch": numbers["branch"].iloc[:1], "counts": [counts.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in frame["counts"])
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "branch": frame["branch"].iloc[:1] // FAN_IN, "counts": [total.tobytes()]})

    kind = "slice int, branch int, counts binary"
    everywhere = index.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))
    numbers = partial.mapInPandas(number, "slice int, branch int, pair long, n long").groupBy("slice", "branch")
    vectors = numbers.cogroup(everywhere.groupBy("slice", "branch")).applyInPandas(dense, kind)
    while branches > 1:
        vectors = vectors.groupBy("slice", F.floor(F.col("branch") / FAN_IN)).applyInPandas(add, kind)
        branches = math.ceil(branches / FAN_IN)
    return vectors.select("slice", "counts")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(slice, levels, keys, counts) of all pairs of a corpus, with the number of pairs and of slices."""
    texts = docs.select(F.col(*quoted(text_col)).cast("string").alias("text"))
    partial = materialise(partial_counts(texts, path_a, path_b), "partial", 512)
    keys = materialise(partial.select("pair").distinct(), "pairs", 10_000)
    n = keys.count()
    index, slices = hash_slices(keys, n)
    index = materialise(index, "hash", 64)
    summed = summed_counts(partial, index, slices, partial.count())
    return materialise(index.join(summed, "slice"), "counts", 64), n, slices


def listed(counts: DataFrame) -> DataFrame:
    """(a, b, pair, n_docs) of every pair."""

    def unpack(frames):
        for frame in frames:
            for keys, counts in zip(frame["keys"], frame["counts"], strict=True):
                pair = np.frombuffer(keys, np.int64)
                yield pd.DataFrame({"a": (pair >> SHIFT).astype(np.int32), "b": (pair & ((1 << SHIFT) - 1)).astype(np.int32), "pair": pair, "n_docs": np.frombuffer(counts, np.int64)})

    return counts.select("keys", "counts").mapInPandas(unpack, "a int, b int, pair long, n_docs long")


def align(docs: DataFrame, path_a: str, path_b: str, most_held: int = 2_000_000, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, and the groups themselves if asked for."""
    spark = docs.sparkSession
    counts, n, slices = pair_counts(docs, path_a, path_b, text_col)
    pairs = listed(counts)
    best = {r["a"]: r["n"] for r in pairs.groupBy("a").agg(F.max("n_docs").alias("n")).collect()}  # one row for each id of A
    if n > most_held:  # those of most documents, by halves of a power of two
        step = F.floor(2 * F.log2("n_docs")).cast("int")
        bins, least = sorted(((r["step"], r["n"]) for r in pairs.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True), 1 << 30
        room = most_held
        for k, m in bins:
            if m > room:
                break
            room, least = room - m, k
        rare, frequent = pairs.where(step < least), materialise(pairs.where(step >= least), "frequent", 10_000)
        index, slices = hash_slices(frequent, max(1, frequent.count()))
        index = materialise(index, "hash", 64)
        as_partial = frequent.select("pair", F.col("n_docs").alias("n"), F.lit(0).alias("task"))
        counts = index.join(summed_counts(as_partial, index, slices, most_held), "slice")
    held = [(r["slice"], [bytes(x) for x in r["levels"]], bytes(r["keys"]), bytes(r["counts"])) for r in counts.collect()]
    highest = np.zeros(max(best, default=0) + 1, np.int64)
    highest[list(best)] = list(best.values())
    shared = spark.sparkContext.broadcast((held, slices, highest))

    def look(frames):
        aligner = _aligner(path_a, path_b, True)
        held, slices, highest = shared.value
        counts = Counts(held, slices)
        for texts in frames:
            numbers, lengths = aligner.texts(texts.tolist())
            used, at = np.unique(numbers, return_inverse=True)
            owner, pair, times = aligner.linked(used)
            found = counts(pair)
            each = np.concatenate([aligner.figures.buffer[used], np.zeros((len(used), 2), np.int64)], axis=1)
            np.add.at(each[:, 4], owner, times * ((found > 0) & (found == highest[np.minimum(pair >> SHIFT, len(highest) - 1)])))
            np.add.at(each[:, 5], owner, times * found)
            stops = np.cumsum(lengths)
            sums = np.zeros((len(lengths), 6), np.int64)
            sums[lengths > 0] = np.add.reduceat(each[at], (stops - lengths)[lengths > 0], axis=0) if len(at) else 0
            missed: dict[int, list] = {}
            for j in np.flatnonzero(found == 0).tolist():
                missed.setdefault(int(owner[j]), []).append((int(pair[j]), int(times[j])))
            named, rows = [aligner.groups[k] for k in used.tolist()], []
            for low, high, figures_of in zip((stops - lengths).tolist(), stops.tolist(), sums.tolist(), strict=True):
                own = at[low:high].tolist()
                groups = ";".join([named[k] for k in own])
                rare: Counter = Counter()
                if missed:
                    for k in own:
                        for p, t in missed.get(k, ()):
                            rare[p] += t
                rows.append((*figures_of, hashlib.sha256(groups.encode()).hexdigest() if own else "", groups if with_groups else None, [{"pair": p, "times": t} for p, t in rare.items()]))
            yield pd.DataFrame(rows, columns=[*figures, "groups_sha256", "groups", "rare"])

    figures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    @F.pandas_udf(f"{', '.join(f + ' long' for f in figures)}, groups_sha256 string, groups string, rare array<struct<pair:long,times:long>>")
    def looked(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from lean(look)(texts)

    own_id, text = (F.col(c) for c in quoted(id_col, text_col))
    told = docs.select(own_id.alias("id"), F.monotonically_increasing_id().alias("row"), looked(text.cast("string")).alias("told")).select("id", "row", "told.*")
    told = materialise(told, "aligned", 512)
    if n > most_held:
        top = F.broadcast(spark.createDataFrame(sorted(best.items()), "a int, highest long"))
        spread = told.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times").join(rare.join(top, "a"), "pair")
        more = spread.groupBy("row").agg(F.sum(F.col("times") * (F.col("n_docs") == F.col("highest")).cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"))
        told = told.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return told.select(F.col("id").alias(id_col), *figures, "groups_sha256", *(["groups"] if with_groups else []))
