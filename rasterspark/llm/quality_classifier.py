"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each text (1 good, -1 bad, 0 no
opinion).  Expectation-maximisation over the counts of vote patterns of all
documents estimates how often each labeller is right when it votes (never less
than by chance; having no opinion says nothing), and so the chance that a text
with given votes is good.  These posterior labels train a linear scorer on
hashed words and word shapes, on a sample of about ``sample`` distinct texts
drawn by a hash of the text (however often one repeats, it trains once); the
scorer then rates every document.

Null or empty text: no word, votes as such, and gets its score like any other.
Texts with equal features have equal scores.  Rows that repeat get the same
score each.  With no documents at all the scorer says 0.5, and an empty table
gives no rows.  Texts of any length are whole.  Other columns, of whatever name,
pass through; a column of the name ``out`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, quoted, with_output

_KIND = bytes(0x61 if chr(c).islower() or c >= 128 else 0x41 if chr(c).isupper() else 0x30 if chr(c).isdigit() else c for c in range(256))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_RUNS = re.compile(rb"([aA0])\1+")


#: Some of the commonest function words of seven languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was on are with as by be this from at not or which "
    "le la les de des du et un une est dans que qui pour par sur au pas ne se "
    "der die das und ist nicht von zu mit den dem ein eine auf im sich auch als "
    "el los las del y en es por con una su para como al lo "
    "il di che per non della con sono e do da em os um uma na no het een van voor niet dat".encode().split()
)


def measures(text: str) -> dict[str, float]:
    """Shares that the labellers judge by."""
    raw = text.encode()
    words, kinds = raw.split(), Counter(raw.translate(_KIND))
    lower, upper, digit = kinds[0x61], kinds[0x41], kinds[0x30]
    space = sum(kinds[c] for c in b" \t\n\r\x0b\x0c")
    n, chars = max(len(words), 1), max(len(raw) - space, 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "words": len(words),
        "upper": upper / max(lower + upper, 1),
        "letters": (lower + upper) / chars,
        "marks": (chars - lower - upper - digit) / chars,
        "digits": digit / chars,
        "distinct": len(set(words)) / n,
        "doubled": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "stops": sum(w[-1] in b".,?" and (len(w) < 2 or w[-2:-1].isalnum() or w[-2] >= 128) for w in words) / n,
        "function": sum(map(FUNCTION_WORDS.__contains__, raw.lower().split())) / n,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
        "alone": sum(len(w) < 4 and not w.translate(None, _MARKS) for w in words) / n,
    }


#: Labellers by name, each with its own margin of doubt.  Most know only one kind
#: of text, and say nothing about others.
LABELLERS = {
    "upper": lambda m: -(m["upper"] > 0.3),
    "marks": lambda m: -(m["marks"] > 0.09),
    "digits": lambda m: -(m["digits"] > 0.2),
    "distinct": lambda m: -(m["distinct"] < 0.15 and m["words"] >= 20),
    "doubled": lambda m: -(m["doubled"] > 0.15),
    "lines": lambda m: -(m["repeated_lines"] > 0.5),
    "alone": lambda m: -(m["alone"] > 0.06),
    "sentences": lambda m: int(0.02 < m["stops"] < 0.3 and m["marks"] < 0.06 and m["doubled"] < 0.05),
    "function": lambda m: int(m["function"] > 0.1 and m["upper"] < 0.2 and m["doubled"] < 0.05),
    "letters": lambda m: int(m["letters"] > 0.93 and m["upper"] < 0.2 and m["distinct"] > 0.3),
}


def votes_of(text: str) -> tuple[int, ...]:
    m = measures(text)
    return tuple(vote(m) for vote in LABELLERS.values())


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.6, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (chance of good per pattern, accuracy per labeller).

    A labeller is right with its accuracy, whichever class a text has.  Starts
    from the sum of the votes.  The chance of good without a vote is ``prior``;
    were it estimated too, the commoner class would swallow texts with one vote.
    """
    good, accuracy = 1 / (1 + np.exp(-2.0 * patterns.sum(axis=1))), np.full(patterns.shape[1], 0.75)
    for _ in range(rounds):
        right = np.where(patterns > 0, good[:, None], 1 - good[:, None]) * (patterns != 0) * counts[:, None]
        voted = ((patterns != 0) * counts[:, None]).sum(axis=0)
        accuracy = np.clip((right.sum(axis=0) + 1.5) / (voted + 2), 0.5, 0.999)
        odds = np.log(prior / (1 - prior)) + patterns @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, accuracy


def features(text: str, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of hashed words and word shapes, and of the repetition of words."""
    raw = text.encode()
    words = raw.split()
    n = max(len(words), 1)
    values: dict[int, float] = {}
    for sign, counts in ((b"w", Counter(words)), (b"s", Counter(_RUNS.sub(rb"\1", raw.translate(_KIND)).split()))):
        for x, k in counts.items():
            bucket = xxhash.xxh3_64_intdigest(sign + x) % n_buckets
            values[bucket] = values.get(bucket, 0.0) + (k / n) ** 0.5
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    for name, value in (("doubled", doubled**0.5), ("alike", 1 - len(set(words)) / n), ("short", 1 / (1 + len(words))), ("one", 1.0)):
        bucket = xxhash.xxh3_64_intdigest(f"\0{name}") % n_buckets
        values[bucket] = values.get(bucket, 0.0) + value
    return np.fromiter(values, np.int64), np.fromiter(values.values(), float)


@dataclass
class QualityModel:
    weights: np.ndarray
    accuracy: np.ndarray
    patterns: dict[tuple[int, ...], float]

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "quality") -> DataFrame:
        """``docs`` plus the chance that each whole text is good."""
        held = docs.sparkSession.sparkContext.broadcast(self.weights)

        @F.pandas_udf("double")
        def rate(texts: pd.Series) -> pd.Series:
            w = held.value

            def one(text):
                bucket, value = features(text, len(w))
                return 1 / (1 + np.exp(-np.clip(w[bucket] @ value, -500, 500)))

            return texts.map(one).astype(float)

        return docs.select(*with_output(docs, {out: rate(_text(text_col))}))


def _text(text_col: str):
    return F.coalesce(F.col(*quoted(text_col)).cast("string"), F.lit(""))


def fit(docs: DataFrame, text_col: str = "text", n_buckets: int = 1 << 14, sample: int = 4000, epochs: int = 10, seed: int = 3) -> QualityModel:
    """Estimate labellers on all documents and train the scorer on a sample of them."""
    rows = docs.select(_text(text_col).alias("text"))

    @F.pandas_udf("string")
    def vote(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ",".join(map(str, votes_of(t))))

    found = rows.select(vote("text").alias("votes"), F.xxhash64("text").alias("mark")).groupBy("votes").agg(F.count("*").alias("count"), F.approx_count_distinct("mark").alias("texts")).toPandas()  # one row per pattern, 3^labellers at most
    if not len(found):
        return QualityModel(np.zeros(n_buckets), np.zeros(len(LABELLERS)), {})
    patterns = np.array([[int(v) for v in p.split(",")] for p in found["votes"]])
    good, accuracy = estimate(patterns, found["count"].to_numpy(float))
    posterior = {tuple(p): float(g) for p, g in zip(patterns.tolist(), good, strict=True)}
    share = sample / max(found["texts"].sum(), 1)
    held = rows.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < F.lit(min(1.0, share) * (1 << 30)))
    held = held.groupBy(F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text"))

    def prepare(frames):
        for pdf in frames:
            out = []
            for t, mark in zip(pdf["text"], pdf["mark"], strict=True):
                bucket, value = features(t, n_buckets)
                out.append((posterior.get(votes_of(t), 0.5), bucket.astype(np.int32).tobytes(), value.tobytes(), mark))
            yield pd.DataFrame(out, columns=["good", "bucket", "value", "mark"])

    data = held.mapInPandas(lean(prepare), "good double, bucket binary, value binary, mark long").toPandas().sort_values("mark", ignore_index=True)  # bounded by ``sample`` texts
    w, squares = np.zeros(n_buckets), np.full(n_buckets, 1e-8)
    rng = np.random.default_rng(seed)
    target, buckets, values = data["good"].to_numpy(), [np.frombuffer(x, np.int32) for x in data["bucket"]], [np.frombuffer(x) for x in data["value"]]
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            bucket, value = buckets[k], values[k]
            p = 1 / (1 + np.exp(-np.clip(w[bucket] @ value, -500, 500)))
            g = (p - target[k]) * value + 1e-5 * w[bucket]
            squares[bucket] += g * g
            w[bucket] -= 0.3 * g / np.sqrt(squares[bucket])
    return QualityModel(w, accuracy, posterior)
