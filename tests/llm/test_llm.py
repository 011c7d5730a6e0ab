"""Operators against brute force on small tables, with nulls, empties, ties and repeated rows."""

import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterspark.llm import chat_format, common, decontamination, embedding_dedup, language_id, links, ngram_join, quality_classifier, source_mix, substring_dedup, suffix_dedup, token_counts
from rasterspark.llm.repeats import rows_of

SCHEMA = "doc_id long, text string, source string, route long, id string"  # with names that operators use inside


def corpus(seed=0, n=60, words=40):
    """Texts with exact and near copies, shared passages, periods, nulls and empties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(45)
    out = [text(rng.randint(1, 2 * words)) for _ in range(n)]
    out += [out[0], out[1] + " tail", text(10) + "\n" + passage + "\t" + text(5), passage, "x " + passage, "ab " * 200, "ab " * 150, None, "", "   ", text(900)]
    near = out[-1].split()
    near[450] = "other"
    out.append(" ".join(near))
    rows = [(k, t, f"s{k % 3}" if k % 7 else None, k, "x") for k, t in enumerate(out)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4)


def later(units, window):
    """Mask per document of the units that a window covers that also starts earlier."""
    seen, out = set(), {}
    for key in sorted(units):
        u, mask = units[key], np.zeros(len(units[key]), bool)
        for s in range(len(u) - window + 1):
            w = tuple(u[s : s + window])
            mask[s : s + window] |= w in seen
            seen.add(w)
        out[key] = mask
    return out


def test_suffix_dedup(docs):
    want = later({r[0]: (r[1] or "").encode() for r in corpus()}, 100)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    texts = {r[0]: (r[1] or "").encode() for r in corpus()}
    assert set(got) == set(want)
    for k, mask in want.items():
        assert bytes(got[k].kept) == np.frombuffer(texts[k], np.uint8)[~mask].tobytes()
        assert sum(x.end - x.start for x in got[k].removed) == mask.sum()


@pytest.mark.parametrize("batches", [1])
def test_substring_dedup(docs, batches):
    texts = {r[0]: (r[1] or "").encode().split() for r in corpus()}
    want = later(texts, 20)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs, n_batches=batches).collect()}
    assert set(got) == set(want)
    for k, mask in want.items():
        assert got[k].kept_words.encode() == b" ".join(w for w, m in zip(texts[k], mask, strict=True) if not m)


@pytest.mark.parametrize("max_runs", [1, 5])
def test_reopened_index_goes_on(spark, docs, max_runs):
    rows = rows_of(docs, "doc_id", "text")
    index = substring_dedup.FingerprintIndex.create(spark, n_buckets=3, max_runs=max_runs)
    kept, runs = [], []
    for low, high in ((-1, 20), (20, 40), (40, 50), (50, 10**6)):
        kept += index.add(rows.where(f"id > {low} AND id <= {high}")).collect()
        runs.append(len(index.state["runs"]))
        spark.sql(f"DROP TABLE fingerprints_{index.state['runs'][-1]}")  # another session has no tables
        index = substring_dedup.FingerprintIndex.open(spark, index.state["path"])
    assert runs == ([1, 2, 2, 2] if max_runs == 1 else [1, 2, 3, 4])
    texts = {r[0]: (r[1] or "").encode().split() for r in corpus()}
    want = later(texts, 20)
    assert {r.id: r.kept_words for r in kept} == {k: b" ".join(w for w, m in zip(texts[k], mask, strict=True) if not m).decode() for k, mask in want.items()}
    with pytest.raises(ValueError, match="above"):
        index.add(rows.where("id = 3"))


def test_equal_hashes_of_other_words_remove_nothing(spark, docs):
    """The words of a source decide, whatever the hashes say."""
    rows = [{"start": 0, "n": 1, "piece": b" ".join(b"w%d" % k for k in range(20))}]
    right, wrong = b" ".join(b"w%d" % k for k in range(25)), b" ".join(b"x%d" % k for k in range(25))
    frame = pd.DataFrame({"id": [1, 2], "tie": [0, 0], "packed": [zstandard.compress(right), zstandard.compress(wrong)], "spans": [rows, rows]})
    got = pd.concat(substring_dedup._keep(20, ("kept", "kept_words"))([frame]))
    assert got["kept_words"].tolist() == ["w20 w21 w22 w23 w24", wrong.decode()]


def test_repeated_rows_have_one_result_each(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (1, text + " more"), (None, text), (None, None)], "doc_id long, text string")
    kept = sorted((r.kept_words for r in substring_dedup.substring_dedup(df).collect()), key=len)
    assert len(kept) == 5
    assert kept[:2] == ["", ""]
    assert suffix_dedup.suffix_dedup(df).count() == 5
    assert substring_dedup.without_repeats(df).columns == df.columns
    assert ngram_join.representatives(df).count() == 2  # one of the near copies, and the empty text
    assert sum(r.n_rows for r in source_mix.mix(df.withColumn("source", F.lit("a"))).collect()) == 5


def test_longest_previous():
    rng = random.Random(1)
    for _ in range(60):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 120)))
        got = suffix_dedup.longest_previous(np.frombuffer(text, np.uint8), 16)
        for i in range(len(text)):
            best = max((next((k for k in range(16) if i + k >= len(text) or text[i + k] != text[j + k]), 16) for j in range(i)), default=0)
            assert got[i] == best


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_ngram_join(docs):
    sets = {r[0]: shingles(r[1]) for r in corpus()}
    linked = {a: {b for b in sets if b != a and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in sets}
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs).collect()}
    for a, near in linked.items():
        reach, new = {a}, {a}
        while new:
            new = set().union(*(linked[x] for x in new)) - reach
            reach |= new
        assert (got[a].n_links, got[a].component_id, got[a].kept) == (len(near), min(reach), min(reach) == a)
    assert sum(r.n_links > 0 for r in got.values()) >= 4


def executions(spark):
    """Ids of the executions that Spark still keeps: only the newest ones."""
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [runs.apply(k).executionId() for k in range(runs.size())]


def join_rows(spark, after):
    """The most rows that a join has made in the executions whose id is above ``after``."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for run in (k for k in executions(spark) if k > after):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("doc_id", [None, 5])
def test_many_texts_under_one_id_meet_their_own_text_only(spark, doc_id):
    base = [[f"d{k}w{j}" for j in range(40)] for k in range(60)]
    texts = [" ".join(w) for w in base] + [" ".join([*w, "end"]) for w in base] + [" ".join(base[0])] * 30
    df = spark.createDataFrame([(doc_id, t) for t in texts] + [(k + 10, f"other {k}") for k in range(20)], "doc_id long, text string").repartition(4)
    before = max(executions(spark), default=-1)
    got = [r for r in ngram_join.jaccard_join(df).collect() if r.n_links]
    assert 0 < join_rows(spark, before) <= 24 * 140  # 24 bands of each class of the 140; the 120 linked with the 150 texts of their id would be 18000
    assert sorted(r.n_links for r in got) == [1] * 118 + [31] * 32
    assert sum(r.kept for r in got) in range(60, 91)
    assert ngram_join.representatives(df).count() == 80


def test_blocks_of_chunks_find_every_pair(spark):
    rows = spark.range(50).select(F.lit(1).cast("long").alias("g"), F.col("id").alias("node"))
    dealt, tasks = links.in_chunks(rows, "g", "node", 8, rows_a_task=100)
    assert tasks == 4  # 7 chunks
    dealt = dealt.toPandas()
    pairs = {}
    for _, b in dealt.groupby(["left", "right"]):
        left, right, both = (set(b.node[b.side == k]) for k in range(3))
        for x, y in [(x, y) for x in left for y in right] + [(x, y) for x in both for y in both if x < y]:
            pairs[frozenset((x, y))] = pairs.get(frozenset((x, y)), 0) + 1
    assert len(pairs) == 50 * 49 // 2
    assert set(pairs.values()) == {1}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30) if k != 15] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in links.components(edges).collect()}
    assert got == {k: 0 if k <= 15 else 16 for k in range(31)} | {100: 100, 101: 100}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 64))
    near = base[:60] + 0.03 * rng.normal(size=(60, 64)) * np.linalg.norm(base[:60], axis=1, keepdims=True)
    vectors = [*base.tolist(), *near.tolist(), base[0].tolist(), None, [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    x = np.array(vectors[:211])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.9) & ~np.eye(211, dtype=bool)
    got = {r.vec_id: r for r in embedding_dedup.lattice_join(df).collect()}
    assert set(got) == set(range(len(vectors)))
    found = sum(got[k].n_links for k in range(211))
    assert 0.9 * link.sum() <= found <= link.sum()
    assert all(got[k].n_links <= link[k].sum() for k in range(211))
    assert all(got[k].n_links == 0 and got[k].kept for k in range(211, 216))


def test_lattice_points_are_nearest():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    p = embedding_dedup.decode(x)
    assert np.allclose(p.sum(axis=1) % 2, 0)
    d = ((x - p) ** 2).sum(axis=1)
    for v in embedding_dedup.least_vectors():
        assert (d <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    parts = [*"aZ's9½٣\u0085 \t\n.,!<|>İΣσς", "<|endoftext|>", "'LL", "日本", "👍🏽", "ﬁ", "\x1b", "hello", " World"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + [None, "", "a" * 5000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    library = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(df, path).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)


def test_chat_format_gives_back_every_turn(spark):
    rows = [(1, 2, "assistant", "b\\b<|im_end|>"), (1, 1, "user", "x\n<|im_sep|>\\p"), (1, 3, "assistant", None), (1, 3, "assistant", "\\"), (2, 1, None, ""), (None, 1, "ro\nle\\n", "<")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    done = chat_format.format_chats(df).select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in done.collect()}
    assert got[1] == ([("user", "x\n<|im_sep|>\\p"), ("assistant", "b\\b<|im_end|>"), ("assistant", ""), ("assistant", "\\")], "b\\b<|im_end|>\\")
    assert got[2] == ([("", "")], "")
    assert got[None] == ([("ro\nle\\n", "<")], "")


def test_source_mix(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", None])) for k in range(900)] + [(k, "w " * 5, "z") for k in range(1000, 1010)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(df, block=64).toPandas()
    assert sorted(got["id"]) == sorted(r[0] for r in rows)
    assert (got["copies"] <= 3).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs((g["size"] * g["copies"]).sum() - g["target"].iloc[0]) <= 60
    again = source_mix.mix(df.repartition(7), block=64).toPandas()
    assert got.sort_values("id")["copies"].tolist() == again.sort_values("id")["copies"].tolist()


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    p, n = np.full(500, 0.37), np.ones(500)
    sizes = rng.integers(1, 5000, 500)
    out = source_mix.flight(p, n, sizes, rng, False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-5)
    assert (out * sizes).sum() == pytest.approx((p * sizes).sum(), rel=1e-6)


def test_targets():
    assert source_mix.targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 187.5, "b": 75.0, None: 37.5}
    capped = source_mix.targets([("a", 10), ("b", 90)])
    assert capped == {"a": 30.0, "b": 70.0}


def test_language_id(spark):
    rng = random.Random(5)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    rows = [(k, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(20)), lang) for k in range(300) for lang in [rng.choice(sorted(letters))]]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !", None), (902, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in model.predict(df).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows if k % 3 == 1) >= 0.97 * sum(k % 3 == 1 for k, _, _ in rows)
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "aa")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert (model.weights == 0).mean() > 0.5
    assert language_id.fit(df.limit(0)).predict(df).where("lang_pred <> 'und'").count() == 0


def test_decontamination(spark):
    item = " ".join(f"word{k}" for k in range(40))
    w = item.split()
    rows = [(1, "intro " + item.upper() + " end"), (2, " ".join(w[20:] + ["gap"] + w[:20])), (3, " ".join(w[:10])), (4, "nothing of it"), (5, None), (6, "")]
    found = decontamination.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string"))
    got = {r.doc_id: [(o["item"], o["coverage"], len(o["tiles"])) for o in r.overlaps] for r in found.collect()}
    assert got == {1: [("7", 1.0, 1)], 2: [("7", 1.0, 2)], 3: [], 4: [], 5: [], 6: []}


def test_tile_marks_longest_first():
    assert decontamination.tile([1, 2, 3, 4, 5, 6], [9, 1, 2, 3, 9, 2, 3, 4, 5, 6], 2) == [(5, 1, 5)]
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.randint(0, 2) for _ in range(rng.randint(1, 25))] for _ in range(2))
        tiles = decontamination.tile(a, b, 3)
        assert all(a[p : p + n] == b[t : t + n] and n >= 3 for t, p, n in tiles)
        for k in (0, 1):
            places = [x + j for tile in tiles for x in [tile[k]] for j in range(tile[2])]
            assert len(places) == len(set(places))


def test_quality(spark):
    rng = random.Random(7)
    clean = lambda: ". ".join(" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(8)) for _ in range(6)) + "."
    rows = [(k, clean() if k % 4 else clean().upper().replace(" ", "!! ")) for k in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.quality for r in quality_classifier.fit(df).score(df).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(k % 4) for k in range(400)]) > 0.97
    assert set(got) == {r[0] for r in rows}


@pytest.mark.parametrize(("n", "least"), [(2, 60), (4, 60), (10, 60)])
def test_language_stage_rejects_by_score(spark, n, least):
    """Of 60 texts in another script at least ``least`` go; short texts of the languages all stay."""
    import corpus_pipeline

    rng = random.Random(8)
    own = lambda k: "".join(chr(0x4E00 + 40 * k + rng.randrange(8)) for _ in range(5))
    word = lambda k: "".join(chr(97 + rng.randrange(26)) for _ in range(5)) if rng.random() > 0.5 else own(k)
    rows = [(i, " ".join(word(i % n) for _ in range(rng.randint(1, 12))), f"l{i % n}") for i in range(80 * n)]
    short = [(5000 + i, own(i % n), None) for i in range(30)]
    planted = [(9000 + i, " ".join("".join(chr(0x430 + rng.randrange(32)) for _ in range(5)) for _ in range(rng.randint(1, 12))), None) for i in range(60)]
    df = spark.createDataFrame([*rows, *short, *planted], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, df, "").collect()}
    assert {r[0] for r in short} <= kept
    assert sum(r[0] not in kept for r in planted) >= least


def test_language_stage_without_labels_keeps_documents(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "some words", None), (2, "слово", None), (3, "12 !", None), (4, None, None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, df, "").collect()} == {1, 2}
    assert [corpus_pipeline.least_score(k) for k in (1, 2, 4)] == [0.4, 0.4, pytest.approx(0.3)]


def test_shared_dir(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
