"""Sharding, cross-tokenizer alignment and whitening against plain versions that look at everything."""

import bisect
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterspark.llm import decontamination, queries, sharding, token_alignment, whitening

SF = "/root/testdata/sf0.001"

# op11


def naive_best_fit(sizes, capacity):
    left, out = [], []
    for size in sizes:
        fits = [(r, k) for k, r in enumerate(left) if r >= size]
        k = min(fits)[1] if fits else len(left)
        left = left if fits else [*left, capacity]
        left[k] -= size
        out.append(k)
    return out


def test_best_fit_equals_a_search_over_all_bins():
    rng = random.Random(5)
    for _ in range(60):
        sizes = sorted((rng.choice([1, rng.randint(1, 40)]) for _ in range(150)), reverse=True)
        assert sharding.best_fit(sizes, 47) == naive_best_fit(sizes, 47)


def test_even_bins_are_near_the_least_possible():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 9)
        sizes = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 300))), reverse=True)
        bins = sharding.even_bins(sizes, n)
        sums = np.bincount(bins, sizes, n)
        assert max(bins) < n and sums.max() <= max(sizes[0], sum(sizes) / n + sizes[0])


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("form", [{"shards": 4}, {"capacity": 3000}, {"shards": 1}])
def test_groups_stay_whole_and_slots_have_no_gaps(spark, form):
    rng = random.Random(1)
    texts = ["hot " * 5] * 400 + [None, "", "", "é" * 3000] + ["".join(rng.choices("ab ", k=rng.randint(0, 60))) for _ in range(600)]
    found = sharding.shard_documents(rows_of(spark, texts).repartition(7), **form).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))
    shard_of, places, sums = {}, {}, Counter()
    for r in found:
        text = texts[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text or "").encode())
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
        places.setdefault(r["shard"], []).append(r["slot"])
        sums[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted(places) == list(range(len(places)))
    groups = Counter()
    for t in texts:
        groups[t] += len((t or "").encode()) + 1
    if "capacity" in form:
        alone = [s for s in groups.values() if s > 3000]
        rest = sorted((s for s in groups.values() if s <= 3000), reverse=True)
        assert len(sums) == len(alone) + max(naive_best_fit(rest, 3000)) + 1
        assert sorted(sums.values())[-len(alone) :] == sorted(alone) and sorted(sums.values())[-len(alone) - 1] <= 3000
    else:
        assert len(sums) == form["shards"]
    again = sharding.shard_documents(rows_of(spark, texts).repartition(7), **form).collect()
    assert {(r["doc_id"], r["shard"]) for r in again} == {(r["doc_id"], r["shard"]) for r in found}


def test_parcels_of_small_groups(spark, monkeypatch):
    """With large grains most groups go into parcels, and several regions pack them."""
    monkeypatch.setattr(sharding, "GRAINS", 4)
    monkeypatch.setattr(sharding, "REGION", 8)
    texts = [f"{k} " + "x" * (k % 50) for k in range(900)]
    total = sum(len(t) + 1 for t in texts)
    even = Counter()
    for r in sharding.shard_documents(rows_of(spark, texts), shards=5).collect():
        even[r["shard"]] += r["size"]
    assert sum(even.values()) == total and max(even.values()) <= total / 5 * 1.3
    fixed, slots = Counter(), {}
    for r in sharding.shard_documents(rows_of(spark, texts), capacity=2000).collect():
        fixed[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(fixed.values()) <= 2000 and len(fixed) < 2.2 * total / 2000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_without_rows_and_with_clashing_columns(spark, tmp_path):
    empty = rows_of(spark, ["x"]).where("doc_id < 0")
    assert sharding.shard_documents(empty, shards=3).count() == 0
    docs = spark.createDataFrame([("a", "t", 1, 2, 3), ("b", None, 4, 5, 6)], "doc_id string, text string, shard int, slot int, `a.b` int")
    found = sharding.shard_documents(docs, shards=2, keep=("a.b", "slot", "text"))
    assert found.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "a.b", "text"]
    assert {(r["doc_id"], r["a.b"], r["text"]) for r in found.collect()} == {("a", 3, "t"), ("b", 6, None)}
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, shards=2, capacity=5)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_op11_query(spark):
    found = queries.op11_sharding(spark, SF).collect()
    sums = Counter()
    for r in found:
        sums[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(sums) <= set(range(16)) and len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()


# op12

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def naive_alignment(texts):
    """(ids of A, ids of B, groups) of each text, by the libraries over whole texts, and counts of pairs."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table, names = token_alignment.byte_table(), {k: v for v, k in a.get_vocab().items()}
    told, count = [], Counter()
    for text in texts:
        own = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(own.decode(), add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(table[c] for c in names[k]) for k in ids_a]
        raw_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(raw_a) != own or b"".join(raw_b) != own:
            told.append(([], [], []))
            continue
        ends = lambda raw: set(np.cumsum([len(x) for x in raw]).tolist())
        cuts = sorted(ends(raw_a) & ends(raw_b))
        groups = [([], []) for _ in cuts]
        for side, (raw, ids) in enumerate(((raw_a, ids_a), (raw_b, ids_b))):
            for k, end in zip(ids, np.cumsum([len(x) for x in raw]).tolist(), strict=True):
                groups[bisect.bisect_left(cuts, end)][side].append(k)
        told.append((ids_a, ids_b, groups))
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    return told, count


def naive_rows(texts):
    told, count = naive_alignment(texts)
    highest = Counter()
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    rows = []
    for ids_a, ids_b, groups in told:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        rows.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), sha))
    return rows


def odd_texts():
    rng = random.Random(4)
    marks = ["a", "Wort", "don't", " ", "  ", "\n", " \n ", "\t", "é", "日本語", "ça", "…", " ", "　", "🙂", " ", "x1", "--", "<|endoftext|>", "<s>", "<0x0A>", "\x00", "ﬁ", "é", "​", "᠎", "\x1c"]
    mixed = ["".join(rng.choice(marks) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return [None, "", " ", "   ", "\n", "▁", "a ▁ b", "a▁b", "z" * 3000, "lang " * 500, "x\u0085 y", *mixed, mixed[0], mixed[0]]


@pytest.mark.parametrize("most_held", [2_000_000, 100])
def test_alignment_equals_the_libraries_over_whole_texts(spark, most_held):
    texts = odd_texts()
    found = token_alignment.align(rows_of(spark, texts).repartition(5), A, B, most_held=most_held).collect()
    want = naive_rows(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in found}
    assert len(found) == len(texts)
    assert [k for k in range(len(texts)) if got[k] != want[k]] == []


def test_op12_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip((r["doc_id"] for r in docs), naive_rows([r["text"] for r in docs]), strict=True))
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op12_token_alignment(spark, SF).collect()} == want


def test_hash_is_minimal_and_tells_foreign_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 100, 20_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        levels, held = token_alignment.build_hash(keys)
        own = token_alignment.PairHash([x.tobytes() for x in levels], held)
        at = own.index(keys)
        assert sorted(at.tolist()) == list(range(len(keys))) and (held[at] == keys).all()
        foreign = np.setdiff1d(rng.integers(0, 1 << 40, 1000), keys)
        assert (own.index(foreign) == -1).all()


def test_vectors_are_summed_in_a_tree(spark, monkeypatch):
    """Many branches and slices give the sums of one."""
    monkeypatch.setattr(token_alignment, "PARTIAL", 3)
    monkeypatch.setattr(token_alignment, "SLICE", 16)
    rng = np.random.default_rng(3)
    rows = [(int(p), int(n), t) for t in range(90) for p, n in zip(rng.choice(100, 20, replace=False), rng.integers(1, 9, 20), strict=True)]
    partial = spark.createDataFrame(rows, "pair long, n long, task int")
    keys = partial.select("pair").distinct()
    index, slices = token_alignment.hash_slices(keys, keys.count())
    found = token_alignment.listed(index.join(token_alignment.summed_counts(partial, index, slices, len(rows)), "slice"))
    want = Counter()
    for p, n, _ in rows:
        want[p] += n
    assert slices > 1 and {r["pair"]: r["n_docs"] for r in found.collect()} == dict(want)


def test_alignment_of_no_rows_and_of_clashing_columns(spark):
    assert token_alignment.align(rows_of(spark, ["x"]).where("doc_id < 0"), A, B).count() == 0
    docs = spark.createDataFrame([("d", "some words", 1), (None, None, 2)], "doc_id string, text string, n_a int")
    found = {r["doc_id"]: (r["n_a"], r["groups"]) for r in token_alignment.align(docs, A, B, with_groups=True).collect()}
    assert found["d"][0] == 2 and found["d"][1].count(";") == 1 and found[None] == (0, "")


# op13


def naive_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    centred = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)
    return x, centred, values[order], directions[:, order]


def check_whitening(spark, vectors, most=32):
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    x, centred, values, directions = naive_whitening(vectors)
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    found, shape = whitening.whiten(df).collect(), (len(vectors), k)
    assert len(found) == len(vectors) * k
    white = np.zeros(shape)
    n, sums = len(vectors), x.astype(np.int64).astype(object).sum(axis=0)
    for r in found:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == int(((n * x[r["vec_id"]].astype(np.int64).astype(object) - sums) ** 2).sum())
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) <= 1e-9 * r["explained"]
        assert r["identity_error"] < 1e-8
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8
    return white, centred, values, directions


def test_whitening_equals_the_eigenvectors(spark):
    rng = np.random.default_rng(1)
    white, centred, values, directions = check_whitening(spark, rng.normal(size=(400, 40)) * np.linspace(1, 4, 40))
    want = centred @ directions[:, :32] / np.sqrt(values[:32])
    sign = np.sign((white * want).sum(axis=0))
    assert np.abs(white - want * sign).max() < 1e-6


@pytest.mark.parametrize("kind", ["few rows", "copies", "equal variances", "one", "two"])
def test_whitening_of_hard_cases(spark, kind):
    rng = np.random.default_rng(2)
    vectors = {
        "few rows": rng.normal(size=(6, 20)), "copies": np.repeat(rng.normal(size=(30, 8)), 9, axis=0), "equal variances": np.vstack([np.eye(24), -np.eye(24)] * 3),
        "one": rng.normal(size=(50, 1)), "two": rng.normal(size=(50, 2)) * [1, 1e-1],
    }[kind]
    check_whitening(spark, vectors)


def test_singular_values_are_accurate_and_vectors_orthogonal():
    rng = np.random.default_rng(3)
    for d, scale in ((1, 1), (2, 1), (7, 1), (30, 1), (30, 0.5), (120, 0.9)):
        a, b = rng.uniform(0.5, 2, d) * float(scale) ** np.arange(d), rng.uniform(0.1, 1, d - 1) * float(scale) ** np.arange(d - 1)
        full = np.diag(a) + np.diag(b, 1)
        want = np.linalg.svd(full)[1]
        assert np.allclose(whitening.dqds(a, b), want, rtol=1e-12, atol=1e-15 * want[0])
        values, z = whitening.right_vectors(a, b, 32)
        assert np.abs(z.T @ z - np.eye(len(values))).max() < 1e-9
        assert np.abs(full.T @ (full @ z) - z * values**2).max() < 1e-12 * want[0] ** 2


def test_small_singular_values_keep_their_digits():
    """A graded bidiagonal matrix: dqds gives its least values to full relative accuracy (against 60-digit fractions)."""
    from fractions import Fraction

    a, b = [Fraction(1, 10 ** (3 * k)) for k in range(4)], [Fraction(1, 10 ** (3 * k + 1)) for k in range(3)]
    found = whitening.dqds(np.array(a, float), np.array(b, float))
    product = Fraction(1)
    for x in a:
        product *= x  # the determinant is the product of singular values
    assert abs(np.prod(found) / float(product) - 1) < 1e-13


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(k), float(k % 3), 1.0]) for k in range(20)] + [(90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 1.0]), (93, [inf, 0.0, 0.0]), (94, [1.0]), (95, []), (96, [1e300, 0.0, 0.0]), (None, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, component int, n string")
    found = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in found} == {*range(20), None} and {r["component"] for r in found} == {1, 2, 3} and {r["n"] for r in found} == {21}
    assert whitening.whiten(df.where("vec_id > 1000")).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0


def test_deviation_beyond_64_bits_is_null():
    x = np.array([[1 << 40, 0], [0, 0]], np.int64)
    assert whitening._squares(x, 2, np.array([1 << 40, 0], object)) == [None, None]
    assert whitening._squares(x // (1 << 20), 2, np.array([1 << 20, 0], object)) == [1 << 40, 1 << 40]


def test_op13_query(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    check = {(r["vec_id"], r["component"]): r for r in queries.op13_whitening(spark, SF).collect()}
    x, centred, values, _ = naive_whitening([r["embedding"] for r in df])
    assert len(check) == 32 * len(df)
    for k in (1, 7, 32):
        assert abs(check[df[0]["vec_id"], k]["explained"] - values[k - 1] / values.sum()) < 1e-9


# op5: phrases that many items and documents share


def test_a_common_phrase_brings_no_pairs_of_its_own(spark):
    """300 texts and 200 items share a phrase; only the texts that hold an item's own words, in any order, meet it."""
    phrase = "once upon a time there".split()
    items = [(k, " ".join([*phrase, *(f"i{k}w{j}" for j in range(25))])) for k in range(200)]
    docs = [(k, " ".join([*(f"d{k}w{j}" for j in range(15)), *phrase])) for k in range(300)]
    moved = [f"i7w{j}" for j in range(12, 25)] + ["and"] + [f"i7w{j}" for j in range(12)]
    docs += [(900, " ".join(moved)), (901, items[8][1]), (902, " ".join(f"i9w{j}" for j in range(9)))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    known = decontamination.seeded(items, 5, "item_id", "text")
    seeds = known.select("item_key", "n_words", "width", F.explode("seeds").alias("s")).select("item_key", "n_words", "width", "s.seed", "s.times")
    rare = decontamination._rare(seeds, 0.5)
    assert rare.groupBy("seed").count().where("count > 1").count() == 0 and rare.groupBy("item_key").count().agg(F.min("count"), F.max("count")).first() == (24, 24)
    found = decontamination.find_overlaps(docs, items).select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.item", "o.coverage").collect()
    assert sorted((r.doc_id, r.item, round(r.coverage, 3)) for r in found) == [(900, "7", 0.833), (901, "8", 1.0)]
