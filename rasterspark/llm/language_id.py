"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Features: 1- to 3-grams of the letters of the lower-cased text (everything else
is a space), hashed to ``n_buckets``; log(1 + count) times inverse document
frequency, scaled to length 1.  Document frequencies come from all training
documents.  Weights come from follow-the-regularised-leader (per-coordinate
rates, L1 and L2 penalties, so that most weights are exactly 0) on a sample of
about ``sample`` distinct texts, as many from each language, drawn by a hash of
the text; however often a text repeats, it trains once.  A temperature fitted on
pieces of a fifth of the sample (whole texts, 12, 3 and 1 words, and mixtures of
two languages, which count half for each) calibrates the scores.  A score is the
probability of the best language times the share of the text's letters that are
in use in the training texts, so a script that none of them has scores 0.

Null text, or text without a letter: ``und`` with score 0.  Training rows with
null text or language don't count; without any, every text is ``und``.  Equal
probabilities go to the first language by code point.  Texts of any length are
whole.  Rows that repeat get the same answer each.  An empty table gives no
rows.  Other columns, of whatever name, pass through; columns of the names
``lang_out`` and ``score_out`` are replaced.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, lean, quoted, setting, with_output

UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Code points of the lower-cased texts behind each other, two spaces after each, which are letters, and the length of each part."""
    parts = [np.frombuffer((t.lower() + "  ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = np.concatenate(parts)
    return codes, _letters()[codes], [len(p) for p in parts]


def gram_counts(texts: list[str], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of hashed 1- to 3-grams that hold a letter, in order of text."""
    return counted(*letters_of(texts), n_buckets)


def counted(codes: np.ndarray, letter: np.ndarray, lengths: list[int], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.where(letter, codes, np.uint32(32))
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths), dtype=np.int64) * n_buckets, lengths)
    shift, found = np.uint32(32 - n_buckets.bit_length() + 1), []
    gram, any_letter = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    for n in range(3):  # two spaces end each text, so what crosses its end is a gram of spaces or ends in them
        m = len(codes) - n
        gram, any_letter = gram[:m] * np.uint32(0x01000193) + codes[n:], any_letter[:m] | letter[n:]
        use = any_letter.copy()
        for k in range(n):  # no gram takes letters of the next text
            at = ends[:-1] - 1 - k
            use[at[(at >= 0) & (at < m)]] = False
        found.append(row[:m][use] + ((gram[use] + np.uint32(n)) * np.uint32(0x9E3779B1) >> shift))
    counts = np.bincount(np.concatenate(found), minlength=len(lengths) * n_buckets)
    used = np.flatnonzero(counts)
    return used // n_buckets, used % n_buckets, counts[used]


def in_batches(texts, chars: int = 400_000, most: int = 64):
    """Index ranges of consecutive texts, so that counts and codes stay small."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and (size + len(t) > chars or k - start >= most):
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def ftrl(features, labels: np.ndarray, n_classes: int, n_buckets: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """Weights (bucket x class); ``features(rows)`` gives a dense block of samples."""
    z, n = np.zeros((n_buckets, n_classes)), np.zeros((n_buckets, n_classes))
    rng = np.random.default_rng(seed)
    weights = lambda: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    w = weights()
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            x = features(rows)
            p = softmax(x @ w)
            p[np.arange(len(rows)), labels[rows]] -= 1
            g = x.T @ p
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
            n += g * g
            w = weights()
    return w


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(scores: np.ndarray, targets: np.ndarray) -> float:
    """The divisor of the scores with the least log loss against target probabilities, by golden section over its logarithm."""
    if not len(targets):
        return 1.0
    loss = lambda t: -(targets * np.log(np.maximum(softmax(scores / np.exp(t)), 1e-300))).sum(axis=1).mean()
    low, high, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def pieces_of(text: str, mark: int) -> list[str]:
    """The whole text, and 12, 3 and 1 of its words in a row."""
    words = text.split()
    starts = [(mark >> 8 * k & 0xFF) * max(len(words) - n + 1, 1) >> 8 for k, n in enumerate((12, 3, 1))]
    return [text] + [" ".join(words[a : a + n]) for a, n in zip(starts, (12, 3, 1), strict=True)]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    n_buckets: int
    letters: np.ndarray  # whether each code point is a letter in use

    def features(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        """TF-IDF value of each counted gram."""
        x = np.log1p(count) * self.idf[bucket]
        return x / np.sqrt(np.bincount(row, x * x))[row]

    def tell(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        codes, letter, lengths = letters_of(texts)
        row, bucket, count = counted(codes, letter, lengths, self.n_buckets)
        x = self.features(row, bucket, count)
        scores = np.stack([np.bincount(row, x * w[bucket], len(texts)) for w in self.weights.T], axis=1)
        p = softmax(scores / self.temperature)
        owner = np.repeat(np.arange(len(texts)), lengths)[letter]
        n_letters = np.bincount(owner, minlength=len(texts))
        known = np.bincount(owner, self.letters[codes[letter]], len(texts)) / np.maximum(n_letters, 1)
        lang = np.array(self.languages, object)[p.argmax(axis=1)]
        lang[n_letters == 0] = UNDETERMINED
        return lang, p.max(axis=1) * known

    def predict(self, docs: DataFrame, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
        """``docs`` plus the most likely language of each whole text and its score."""
        held = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("lang string, score double")
        def tell(parts: pd.Series) -> pd.DataFrame:
            model, texts = held.value, parts.tolist()
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            for a, b in in_batches(texts) if model.languages else ():
                lang[a:b], score[a:b] = model.tell(texts[a:b])
            return pd.DataFrame({"lang": lang, "score": score})

        (told,) = free_names(docs, "told")
        out = docs.withColumn(told, tell(F.coalesce(F.col(*quoted(text_col)).cast("string"), F.lit(""))))
        return out.select(*with_output(docs, {lang_out: F.col(told)["lang"], score_out: F.col(told)["score"]}))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n_buckets: int = 1 << 14, sample: int = 4000, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, rare: float = 1e-6, seed: int = 5) -> LanguageModel:
    """Train on all rows of ``docs`` with text and language.

    A letter is in use if it makes up at least ``rare`` of all letters.
    """
    text, lang = (F.col(c).cast("string") for c in quoted(text_col, lang_col))
    rows = docs.select(text.alias("text"), lang.alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    languages = sorted(by_lang)
    if not languages:
        return LanguageModel([], np.zeros(n_buckets), np.zeros((n_buckets, 0)), 1.0, n_buckets, np.zeros(0x110000, bool))

    def frequencies(frames):
        df, n, letters = np.zeros(n_buckets, np.int64), 0, np.zeros(0x110000, np.int64)
        for pdf in frames:
            texts = pdf["text"].tolist()
            for a, b in in_batches(texts):
                codes, letter, lengths = letters_of(texts[a:b])
                df += np.bincount(counted(codes, letter, lengths, n_buckets)[1], minlength=n_buckets)
                seen, times = np.unique(codes[letter], return_counts=True)
                letters[seen] += times
            n += len(texts)
        if n:
            for kind, counts in (("texts", np.array([n])), ("grams", df), ("letters", letters)):
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"kind": kind, "place": used, "n": counts[used]})

    with setting(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="2048"):
        found = rows.select("text").mapInPandas(lean(frequencies), "kind string, place int, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toPandas()  # one row for each bucket and code point at most
    counts = {kind: np.zeros(size) for kind, size in (("texts", 1), ("grams", n_buckets), ("letters", 0x110000))}
    for kind, part in found.groupby("kind"):
        counts[kind][part["place"].to_numpy()] = part["n"].to_numpy()
    idf = np.log((1 + counts["texts"][0]) / (1 + counts["grams"])) + 1
    letters = counts["letters"] > rare * counts["letters"].sum()

    share = sample / len(languages)
    picked = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[F.lit(x) for lang, n in by_lang.items() for x in (lang, min(1.0, share / n))])
    held = rows.where(picked < F.try_element_at(limit, F.col("lang"))).groupBy(F.xxhash64("text").alias("mark"), "lang").agg(F.first("text").alias("text"))

    def sparse(frames):
        for pdf in frames:
            texts, of = [], []
            for k, (text, mark) in enumerate(zip(pdf["text"], pdf["mark"], strict=True)):
                own = pieces_of(text, mark) if mark % 5 == 0 else [text]  # a fifth calibrates, the rest trains
                texts += own
                of += [(k, n) for n in range(len(own))]
            for a, b in in_batches(texts):
                row, bucket, count = gram_counts(texts[a:b], n_buckets)
                at = np.searchsorted(row, np.arange(b - a + 1))
                out = []
                for n in range(b - a):
                    k, piece = of[a + n]
                    own = slice(at[n], at[n + 1])
                    out.append((pdf["mark"][k], pdf["lang"][k], piece, bucket[own].astype(np.uint32).tobytes(), count[own].astype(np.uint32).tobytes()))
                yield pd.DataFrame(out, columns=["mark", "lang", "piece", "used", "counts"])

    data = held.mapInPandas(lean(sparse), "mark long, lang string, piece int, used binary, counts binary").toPandas()  # bounded by ``sample`` texts
    data = data[data["used"].str.len() > 0].sort_values(["mark", "lang", "piece"], ignore_index=True)
    labels = data["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64)
    grams = [(np.frombuffer(u, np.uint32), np.frombuffer(c, np.uint32)) for u, c in zip(data["used"], data["counts"], strict=True)]
    model = LanguageModel(languages, idf, np.zeros((n_buckets, len(languages))), 1.0, n_buckets, letters)

    def dense(some):
        x = np.zeros((len(some), n_buckets))
        for k, (bucket, count) in enumerate(some):
            x[k, bucket] = model.features(np.zeros(len(bucket), np.int64), bucket, count)
        return x

    held_out = (data["mark"] % 5 == 0).to_numpy() if len(data) else np.zeros(0, bool)
    train = np.flatnonzero(~held_out)
    if not len(train):  # so few texts that none was left to train
        train = np.flatnonzero(data["piece"].to_numpy() == 0)
    if len(train):
        model.weights = ftrl(lambda k: dense([grams[r] for r in train[k]]), labels[train], len(languages), n_buckets, epochs, alpha, beta, l1, l2, seed)
        own = np.flatnonzero(held_out)
        own = own[np.argsort(data["piece"].to_numpy()[own], kind="stable")]  # pieces of a kind stand next to each other
        some, targets = [grams[r] for r in own], list(np.eye(len(languages))[labels[own]])
        for a, b in zip(own, np.roll(own, -1), strict=True):
            if labels[a] != labels[b] and data["piece"][a] == data["piece"][b]:
                bucket, at = np.unique(np.concatenate([grams[a][0], grams[b][0]]), return_inverse=True)
                some.append((bucket, np.bincount(at, np.concatenate([grams[a][1], grams[b][1]]))))
                targets.append((np.eye(len(languages))[labels[a]] + np.eye(len(languages))[labels[b]]) / 2)
        scores = np.concatenate([dense(some[k : k + 32]) @ model.weights for k in range(0, len(some), 32)] or [np.zeros((0, len(languages)))])
        model.temperature = temperature(scores, np.array(targets))
    return model
