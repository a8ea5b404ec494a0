"""The stages of the corpus pipeline in a row, each against brute force on what the one before kept."""

from collections import Counter

import public_tokenizers

import corpus_pipeline
from tests.llm.test_operators import brute_near, corpus, docs  # noqa: F401


def test_stages_in_a_row(spark, docs, corpus, tmp_path):  # noqa: F811
    from tokenizers import Tokenizer

    spread = next(t for t in corpus.values() if t and len(t.split()) == 34)
    spark.createDataFrame([(1, " ".join(spread.split()[3:20]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, now, out = dict(corpus_pipeline.STAGES), docs, {}
    for name, stage in stages.items():
        now = corpus_pipeline.in_shared_folder(stage(spark, now, str(tmp_path)), f"test-{name}")
        out[name] = now
        assert name == "token_ids" or now.columns == docs.columns
    ids = {name: {r.doc_id for r in out[name].select("doc_id").collect()} for name in ("language_id", "near_dedup", "decontamination")}
    lettered = {i: t for i, t in corpus.items() if t and any(c.isalpha() for c in t)}
    assert ids["language_id"] == set(lettered)
    alone = {i for i, (_, component) in brute_near(lettered.items()).items() if i == component}
    assert ids["near_dedup"] == alone
    assert ids["decontamination"] == {i for i in alone if lettered[i] != spread}
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = Counter((r.doc_id, len(encode(r.text or "", add_special_tokens=False).ids) + 1) for r in out["mixing"].select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_tokens) for r in out["token_ids"].select("doc_id", "n_tokens").collect()) == want


def test_rows_of_one_id_are_judged_apart(spark, tmp_path):
    a, b = (" ".join(f"{x}{n}" for n in range(40)) for x in "ab")
    rows = [(1, a), (1, a), (None, a), (None, a), (2, b), (2, a), (3, b)]
    docs = spark.createDataFrame([(i, t, f"k{n}") for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, row_key string")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == [a, b]
    same = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, same, str(tmp_path)).collect()) == [a, b]
    empty = spark.createDataFrame([(5, ""), (5, ""), (6, None), (None, "")], "doc_id bigint, text string")
    assert Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, empty, str(tmp_path)).collect()) == {(5, ""): 1, (6, None): 1, (None, ""): 1}

    spark.createDataFrame([(1, " ".join(a.split()[3:20]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == {(2, b): 1, (3, b): 1}
    assert clean.columns == docs.columns


def test_language_without_labels_and_with_clashing_columns(spark, tmp_path):
    rows = [(1, "some words", None, 1), (2, "...", None, 2), (3, None, None, 3), (1, "ein wort", None, 4), (4, "", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    assert sorted(map(tuple, corpus_pipeline.language(spark, docs, str(tmp_path)).collect())) == [rows[3], rows[0]]
    labelled = [(i, "the quick brown fox" if i % 2 else "der schnelle braune fuchs", "en" if i % 2 else "de", "mine", "p") for i in range(40)]
    more = spark.createDataFrame(labelled, "doc_id bigint, text string, lang string, lang_pred string, score string")
    got = corpus_pipeline.language(spark, more, str(tmp_path))
    assert got.columns == more.columns and sorted(map(tuple, got.collect())) == sorted(labelled)


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.in_shared_folder(stage(spark, now, str(tmp_path)), f"empty-{name}")
        assert now.count() == 0
