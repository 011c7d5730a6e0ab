"""Clashing column names, empty tables and very long texts, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from rasterspark.llm import chat_format, common, decontamination, embedding_dedup, language_id, ngram_join, quality_classifier, source_mix, substring_dedup, suffix_dedup, token_counts

NAMES = [
    "copies", "_id", "_tie", "_kept", "_null", "_told", "_score", "row_id", "row_tie", "no_text", "kept_text", "told", "key1", "key2", "matches", "mix_id", "mix_source", "mix_size", "mix_copies",
    "plan_source", "node", "band", "id", "tie", "size", "n_rows", "packed", "spans", "lang_pred", "score", "overlaps", "n_tokens", "quality", "a.b", "row", "place", "turns", "pieces",
]


def with_names(df):
    return df.select("*", *[F.concat(F.lit(f"{n}="), F.col("doc_id")).alias(n) for n in NAMES])


def texts(n=6):
    long_text = " ".join(f"word{k % 977}x{k % 13}" for k in range(20_000))
    words = [" ".join(f"w{k}n{j}" for j in range(30)) for k in range(n)]
    return [(k, t, f"s{k % 2}", "en" if k % 2 else "fr") for k, t in enumerate([*words, words[0] + " more", long_text, None, ""])]


@pytest.fixture(scope="module")
def named(spark):
    return with_names(spark.createDataFrame(texts(), "doc_id long, text string, source string, lang string"))


def passes(out, *replaced):
    """All columns are there once, and hold what they held."""
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}={r.doc_id}" for n in NAMES if n not in replaced)
    return rows


def items(spark):
    return spark.createDataFrame([(1, " ".join(f"w0n{j}" for j in range(30)))], "item_id long, text string")


def test_columns_that_clash_pass_through(spark, named):
    rows = passes(source_mix.take(named), "copies")
    assert all(r.copies > 0 for r in rows)
    model = language_id.fit(named)
    rows = passes(model.predict(named), "lang_pred", "score")
    assert {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    rows = passes(token_counts.count_tokens(named, token_path()), "n_tokens")
    assert all(isinstance(r.n_tokens, int) for r in rows)
    rows = passes(quality_classifier.fit(named).score(named), "quality")
    assert all(isinstance(r.quality, float) for r in rows)
    rows = passes(decontamination.find_overlaps(named, items(spark)), "overlaps")
    assert {r.doc_id for r in rows if r.overlaps} == {0, 6}
    assert {r.doc_id for r in passes(decontamination.without_overlaps(named, items(spark)))} == {1, 2, 3, 4, 5, 7, 8, 9}
    assert {r.doc_id for r in passes(ngram_join.representatives(named))} == {0, 1, 2, 3, 4, 5, 7, 8, 9}
    assert {r.doc_id for r in passes(substring_dedup.without_repeats(named))} == set(range(10))


def token_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_operators_that_read_few_columns_ignore_the_others(spark, named):
    assert suffix_dedup.suffix_dedup(named).count() == 10
    assert ngram_join.jaccard_join(named).count() == 10
    assert source_mix.mix(named).count() == 10
    assert substring_dedup.substring_dedup(named).where("n_words = 20000 AND size(removed) < 20000").count() == 1
    turns = named.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", *common.quoted(*NAMES))
    assert chat_format.format_chats(turns).count() == 1
    vectors = named.select("doc_id", F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id") + 1.0, F.lit(1.0)).alias("embedding"), *common.quoted(*NAMES))
    assert embedding_dedup.lattice_join(vectors).count() == 10


def test_pipeline_with_clashing_names(spark, named, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    given = named.drop("a.b").withColumn("n_chars", F.length("text").cast("long"))
    given.write.parquet(f"{tmp_path}/documents.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == set(given.columns)
    for r in out.collect():
        assert r.copies in (1, 2, 3)
        assert r["_score"] == f"_score={r.doc_id}"
        assert r.doc_id != 0


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    none = spark.createDataFrame([], "item_id long, text string")
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert substring_dedup.without_repeats(empty).count() == 0
    assert ngram_join.jaccard_join(empty).count() == 0
    assert ngram_join.representatives(empty).count() == 0
    assert source_mix.mix(empty).count() == 0
    assert source_mix.take(empty).count() == 0
    assert quality_classifier.fit(empty).score(empty).count() == 0
    assert language_id.fit(empty).predict(empty).count() == 0
    assert token_counts.count_tokens(empty, token_path()).count() == 0
    assert decontamination.find_overlaps(empty, items(spark)).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontamination.find_overlaps(some, none).where("size(overlaps) = 0").count() == 1
    assert embedding_dedup.lattice_join(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0
    pipeline = pytest.importorskip("corpus_pipeline")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    none.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_crowded_key_of_suffix_dedup(spark):
    """A passage in surroundings of their own, with windows dealt out by hash or compared by suffix array."""
    passage = "the passage that all of them hold, a hundred bytes long and somewhat more than that, so that it repeats"
    df = spark.createDataFrame([(k, f"{k * 7919 % 1000:03d} {passage} {k * 104729 % 1000:03d}") for k in range(60)], "doc_id long, text string")
    one, two = ({r.doc_id: (bytes(r.kept), len(r.removed)) for r in suffix_dedup.suffix_dedup(df, crowded=n).collect()} for n in (5, 10_000))
    assert one == two
    assert sum(x[1] for x in one.values()) >= 59


def test_frequent_class_is_joined_apart(spark):
    rows = spark.createDataFrame([(k, 1 if k < 900 else k) for k in range(1200)], "id long, node long")
    figures = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    from rasterspark.llm.links import with_figures

    got = with_figures(rows, figures, "node", "copies", 1200)
    assert got.count() == 1200
    assert got.where("least <> IF(id < 900, 0, id)").count() == 0
    apart = with_figures(rows, figures.where("node <> 1000"), "node", "copies", 100_000)
    assert apart.count() == 1200
    assert apart.where("least IS NULL").count() == 1


def test_whole_groups_over_frames():
    import pandas as pd

    frames = [pd.DataFrame({"a": a, "v": range(len(a))}) for a in ([1, 1, 2], [2, 2], [2, 3, 4], [], [4], [5])]
    parts = list(common.whole_groups(frames, ["a"]))
    assert sum(map(len, parts)) == 10
    firsts = [set(p["a"]) for p in parts]
    assert all(not a & b for i, a in enumerate(firsts) for b in firsts[i + 1 :])
