"""Operators, registered queries and pipeline stages against plain versions that look at everything."""

import hashlib
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from test_llm import corpus, later, shingles
from tokenizers import Tokenizer

from rasterspark.llm import decontamination, language_id, quality_classifier, queries, source_mix
from rasterspark.llm.common import materialise

# op1


def test_landing_is_near_the_best_of_all_choices():
    """No one change and no exchange comes nearer, and over many cases little is lost against the best of all choices."""
    rng, lost = np.random.default_rng(1), []
    for _ in range(60):
        n = int(rng.integers(4, 12))
        sizes, p = rng.integers(1, 60, n), float(rng.uniform(0.1, 0.9))
        want = p * sizes.sum()
        error = lambda c: abs(np.dot(sizes, c) - want)  # noqa: B023, E731
        got = source_mix.flight(np.full(n, p), np.ones(n), sizes, rng, True)
        assert set(got) <= {0.0, 1.0}
        for i, j in itertools.product(range(n), repeat=2):
            other = got.copy()
            other[i] = 1 - other[i]
            if i != j and got[i] != got[j]:
                other[j] = 1 - other[j]
            assert error(got) <= error(other) + 1e-9
        lost.append(error(got) - min(map(error, itertools.product((0, 1), repeat=n))))
    assert np.mean(lost) < 2


def naive_targets(sizes, weights=(5, 2, 1), cap=3.0):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    total, open_, out = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(out.values())
        weight = {s: weights[k % 3] for k, s in enumerate(order) if s in open_}
        over = {s for s in open_ if left * weight[s] / sum(weight.values()) > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / sum(weight.values()) for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over


def test_many_sources_by_shuffle_give_the_same_mix(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", None])) for k in range(500)], "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, source_mix.mix(df, block=64, most_broadcast=most).collect()), key=str) for most in (100, 0))
    assert one == two


# op2


def naive_ftrl(x, labels, n_classes, epochs, alpha, beta, l1, l2, seed):
    n_buckets = x.shape[1]
    z, n = np.zeros((n_buckets, n_classes)), np.zeros((n_buckets, n_classes))
    rng = np.random.default_rng(seed)

    def weight(i, c):
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - math.copysign(l1, z[i, c])) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 32):
            w = np.array([[weight(i, c) for c in range(n_classes)] for i in range(n_buckets)])
            g = np.zeros((n_buckets, n_classes))
            for r in order[at : at + 32]:
                e = [math.exp(x[r] @ w[:, c]) for c in range(n_classes)]
                for c in range(n_classes):
                    g[:, c] += x[r] * (e[c] / sum(e) - (labels[r] == c))
            for i in range(n_buckets):
                for c in range(n_classes):
                    sigma = (math.sqrt(n[i, c] + g[i, c] ** 2) - math.sqrt(n[i, c])) / alpha
                    z[i, c] += g[i, c] - sigma * w[i, c]
                    n[i, c] += g[i, c] ** 2
    return np.array([[weight(i, c) for c in range(n_classes)] for i in range(n_buckets)])


def test_ftrl_is_the_coordinate_wise_rule():
    rng = np.random.default_rng(2)
    x, labels = rng.random((80, 12)) * (rng.random((80, 12)) > 0.5), rng.integers(0, 3, 80)
    got = language_id.ftrl(lambda rows: x[rows], labels, 3, 12, 3, 0.7, 1.0, 0.1, 0.01, 5)
    assert np.allclose(got, naive_ftrl(x, labels, 3, 3, 0.7, 1.0, 0.1, 0.01, 5), atol=1e-9)


def test_gram_counts_are_those_of_each_text():
    texts = ["abc", "", "ab  ab1c", "é!"]
    row, bucket, count = language_id.gram_counts(texts, 1 << 12)
    for k, t in enumerate(texts):
        alone = language_id.gram_counts([t], 1 << 12)
        assert (bucket[row == k].tolist(), count[row == k].tolist()) == (alone[1].tolist(), alone[2].tolist())
    codes = "".join(c if c.isalpha() else " " for c in texts[2] + "  ")
    grams = [codes[i : i + n] for n in (1, 2, 3) for i in range(len(codes) - n + 1)]
    assert count[row == 2].sum() == sum(any(c.isalpha() for c in g) for g in grams)


def test_calibrated_scores_tell_doubt(spark):
    rng = random.Random(9)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnab"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(4))
    rows = [(k, " ".join(word(lang) for _ in range(rng.randint(1, 20))), lang) for k in range(600) for lang in [rng.choice(sorted(letters))]]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.temperature > 0.1
    _, score = model.tell([" ".join(word("aa") for _ in range(15)), " ".join(word(x) for x in ("aa", "bb") * 8), "слово здесь", "aaaa слово"])
    assert score[0] > 0.9 > score[1] > 0.3
    assert score[2] == 0
    assert score[3] <= 4 / 9


def test_training_rows_are_bounded_and_distinct(spark):
    same = [(k, "the same text again", "aa") for k in range(3000)]
    other = [(5000 + k, f"text {k} of many", "aa" if k % 2 else "bb") for k in range(300)]
    df = spark.createDataFrame(same + other, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(df, sample=100)
    assert model.languages == ["aa", "bb"]
    quality = quality_classifier.fit(df, sample=100)
    assert quality.score(df).where("quality BETWEEN 0 AND 1").count() == 3300


# op4


def test_em_is_the_one_coin_rule():
    rng = random.Random(4)
    truth = [rng.random() < 0.6 for _ in range(2000)]
    votes = [tuple(0 if rng.random() < 0.4 else (1 if t == (rng.random() < a) else -1) for a in (0.9, 0.8, 0.7, 0.6)) for t in truth]
    patterns = sorted(set(votes))
    counts = np.array([votes.count(p) for p in patterns], float)
    good, accuracy = quality_classifier.estimate(np.array(patterns), counts)
    g, a = {p: 1 / (1 + math.exp(-2 * sum(p))) for p in patterns}, None
    for _ in range(200):
        a = []
        for k in range(4):
            voted = sum(n for p, n in zip(patterns, counts, strict=True) if p[k])
            right = sum(n * (g[p] if p[k] > 0 else 1 - g[p]) for p, n in zip(patterns, counts, strict=True) if p[k])
            a.append(min(max((right + 1.5) / (voted + 2), 0.5), 0.999))
        for p in patterns:
            yes, no = 0.6, 0.4
            for v, x in zip(p, a, strict=True):
                yes *= {1: x, -1: 1 - x, 0: 1}[v]
                no *= {-1: x, 1: 1 - x, 0: 1}[v]
            g[p] = yes / (yes + no)
    assert np.allclose(good, [g[p] for p in patterns], atol=1e-6)
    assert np.allclose(accuracy, a, atol=1e-6)
    assert np.abs(np.array(a) - (0.9, 0.8, 0.7, 0.6)).max() < 0.08


def test_quality_ranks_labelled_documents(spark):
    folder = "/root/testdata/sf0.001"
    rated = quality_classifier.fit(spark.read.parquet(f"{folder}/documents.parquet")).score(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = rated.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F_quality()), "doc_id").select("label", "quality").collect()
    good, bad = ([r.quality for r in rows if r.label == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc >= 0.95


def F_quality():
    from pyspark.sql import functions as F

    return F.col("quality").alias("label")


# op5


def naive_tiles(pattern, text, least):
    used_p, used_t, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for p in range(len(pattern)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and p + n not in used_p and t + n not in used_t:
                    n += 1
                if n > best[0]:
                    best = (n, t, p)
        n, t, p = best
        if n < least:
            return sorted(tiles)
        used_p |= set(range(p, p + n))
        used_t |= set(range(t, t + n))
        tiles.append((t, p, n))


def test_tiles_are_those_of_naive_greedy_tiling():
    rng = random.Random(6)
    for k in range(300):
        a, b = ([rng.randint(0, 2 + k % 3) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert sorted(decontamination.tile(a, b, 3)) == naive_tiles(a, b, 3)


# queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small folder of tables with nulls, copies, passages of the benchmark and repeated turns."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, ["en", "fr", None][k % 3], s, len(t or "")) for k, t, s, _, _ in corpus(5, 60)]
    words = corpus(5, 60)[0][1] or "none at all"
    items = [(1, " ".join(words.split()[:30])), (2, "ab ab ab ab ab ab"), (3, None), (4, ""), (5, "three words only")]
    long_text = " ".join(f"word{k % 977}x{k % 13}" for k in range(20_000))
    rows += [(900, long_text, "en", "s1", len(long_text)), (901, "before " + items[0][1] + " after", "en", "s1", 9), (902, "THREE, words only!", "en", "s2", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b\\p<|"), (1, 2, "assistant", "c"), (2, None, None, None), (None, 1, "user", "z")], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 16))
    near = x[:20] + 0.02 * rng.normal(size=(20, 16))
    vectors = [*x.tolist(), *near.tolist(), x[0].tolist(), None, [0.0] * 16]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def components_of(linked):
    out = {}
    for a in linked:
        reach, new = {a}, {a}
        while new:
            new = set().union(*(linked[x] for x in new)) - reach
            reach |= new
        out[a] = min(reach)
    return out


def test_op1_query(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    n = {k: len((r.text or "").encode().split()) for k, r in docs.items()}
    sizes = {}
    for k, r in docs.items():
        sizes[r.source] = sizes.get(r.source, 0) + n[k]
    target = naive_targets(sizes)
    got = queries.op1_source_mix(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        source = docs[r.doc_id].source
        assert (r.size, r.source_size, r.target) == (n[r.doc_id], sizes[source], pytest.approx(target[source]))
        assert r.taken <= 3 * r.size
        assert not r.size or r.taken % r.size == 0
    for s, want in target.items():
        taken = sum(r.taken for r in got if docs[r.doc_id].source == s)
        largest = max(n[k] for k, r in docs.items() if r.source == s)  # a source of few large documents can't come nearer
        assert abs(taken - want) <= max(0.005 * want, 2, largest / 2)


def test_op2_query(spark, folder):
    import zlib

    texts = texts_of(spark, folder)
    got = queries.op2_language_id(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
        assert 0 <= r.score <= 1


def test_op3_query(spark, folder):
    library, texts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), texts_of(spark, folder)
    for r in queries.op3_token_counts(spark, folder).collect():
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


def test_op4_query(spark, folder):
    rows = queries.op4_quality_classifier(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts_of(spark, folder))
    assert all(r.kept == (r.quality >= 0.5) for r in rows)


def naive_overlaps(texts, items):
    out = set()
    for d, text in texts.items():
        words = decontamination.words_of(text or "").tolist()
        for i, item in items:
            pattern = decontamination.words_of(item or "").tolist()
            tiles = naive_tiles(pattern, words, min(5, len(pattern))) if pattern and set(pattern) & set(words) else []
            if pattern and sum(n for _, _, n in tiles) >= len(pattern) / 2:
                out.add((d, i, sum(n for _, _, n in tiles) / len(pattern), len(tiles)))
    return out


def test_op5_query(spark, folder):
    texts = {k: t for k, t in texts_of(spark, folder).items() if k != 900}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in queries.op5_decontamination(spark, folder).collect()}
    assert got == naive_overlaps(texts, items)
    assert {901, 902} <= {d for d, *_ in got}


def test_op6_query(spark, folder):
    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    got = {r.conv_id: r for r in queries.op6_chat_format(spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        told, loss = "".join(f"{x[2]}\n{x[3]}\n" for x in own), "".join(x[3] for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op7_and_op8_queries(spark, folder):
    texts = {k: (t or "").encode() for k, t in texts_of(spark, folder).items()}
    masks = later(texts, 100)
    for r in queries.op7_suffix_dedup(spark, folder).collect():
        raw, mask = texts[r.doc_id], masks[r.doc_id]
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        n_spans = int((np.diff(np.r_[False, mask].astype(int)) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), mask.sum(), n_spans, hashlib.sha256(kept).hexdigest())
    words = {k: t.split() for k, t in texts.items()}
    masks = later(words, 20)
    for r in queries.op8_substring_dedup(spark, folder).collect():
        kept = b" ".join(w for w, m in zip(words[r.doc_id], masks[r.doc_id], strict=True) if not m)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words[r.doc_id]), masks[r.doc_id].sum(), hashlib.sha256(kept).hexdigest())


def test_op9_query(spark, folder):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    sound = {k: np.array(v, float) for k, v in vectors.items() if v and any(v)}
    cosine = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    linked = {a: {b for b in sound if a in sound and b != a and cosine(sound[a], sound[b]) >= 0.9} for a in vectors}
    low = components_of(linked)
    for r in queries.op9_embedding_dedup(spark, folder).collect():
        assert (r.n_links, r.component_id, r.kept) == (len(linked[r.vec_id]), low[r.vec_id], low[r.vec_id] == r.vec_id)


def test_op10_query(spark, folder):
    sets = {k: shingles(t) for k, t in texts_of(spark, folder).items()}
    linked = {a: {b for b in sets if b != a and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in sets}
    low = components_of(linked)
    for r in queries.op10_ngram_join(spark, folder).collect():
        assert (r.doc_id, r.n_links, r.component_id, r.kept) == (r.doc_id, len(linked[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)


def test_pipeline_is_its_stages_one_after_another(spark, folder):
    """Each stage against a plain version, over what the stage before has kept; the model's rejections are taken as given."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert len(seen[name]) == docs.count()
    kept = {k: r.text for k, r in seen["language_id"].items()}
    assert set(kept) <= {k for k, t in texts_of(spark, folder).items() if any(c.isalpha() for c in t or "")}
    sets = {k: shingles(t) for k, t in kept.items()}
    linked = {a: {b for b in sets if b != a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in sets}
    low = components_of(linked)
    kept = {k: t for k, t in kept.items() if low[k] == k}
    assert {k: r.text for k, r in seen["ngram_join"].items()} == kept
    words = {k: t.encode().split() for k, t in kept.items()}
    masks = later(words, 20)
    stay = {k: [w for w, m in zip(words[k], masks[k], strict=True) if not m] for k in kept}
    assert {k: r.text.encode().split() for k, r in seen["substring_dedup"].items()} == {k: w for k, w in stay.items() if w}
    assert all(r.n_chars == len(r.text) for r in seen["substring_dedup"].values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {k: r.text for k, r in seen["substring_dedup"].items() if k != 900}
    leaked = {d for d, *_ in naive_overlaps(texts, items)}
    assert set(seen["decontamination"]) == set(seen["substring_dedup"]) - leaked
    assert leaked
    n, sizes = {k: len(r.text.encode().split()) for k, r in seen["decontamination"].items()}, {}
    for k, r in seen["decontamination"].items():
        sizes[r.source] = sizes.get(r.source, 0) + n[k]
    for s, want in naive_targets(sizes).items():
        taken = sum(n[k] * r.copies for k, r in seen["source_mix"].items() if r.source == s)
        assert abs(taken - want) <= max(0.005 * want, max(n[k] for k, r in seen["decontamination"].items() if r.source == s) / 2)
    assert sorted((r.doc_id, r.text, r.copies) for r in pipeline.run(spark, folder).collect()) == sorted((k, r.text, r.copies) for k, r in seen["source_mix"].items())


