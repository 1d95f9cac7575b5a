"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from waygraph.llm import decontaminate, langid, licenses, neardup, quality_fm, quality_rules, sentencepieces, sharding, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["kept", "score", "key", "row", "host", "label", "hash", "lang_pred", "shard", "n", "band", "registers"]
LONG = " ".join(f"word{i % 977}{'x' * (i % 7)}" for i in range(30_000))
ROWS = [
    (1, "A plain text of some ten words that says very little here.", "en", "a", 60),
    (1, "A plain text of some ten words that says very little here.", "en", "a", 60),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, LONG, None, "b", len(LONG)),
    (5, "   \n\t ", "de", "b", 6),
    (6, "x" * 50_000, "de", "b", 50_000),
    (None, "Ein Text ohne Nummer, der trotzdem gezählt wird und Wörter hat.", "de", None, 63),
    (7, "Un texte <|endoftext|> avec 日本語 et é́ 😀.", "fr", "c", 40),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return sorted(df.collect(), key=str)


def test_quality_rules(docs, none):
    got = quality_rules.apply_rules(docs).select("doc_id", "n_words", "base_failed", "kept").collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_words == by[3].n_words == by[5].n_words == 0
    assert by[2].base_failed and not by[2].kept
    assert by[1].kept
    assert quality_rules.apply_rules(none).count() == 0
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 1").count() == 2
    assert quality_rules.keep_documents(none).count() == 0


def test_langid(docs, none):
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.label(docs, model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[5].lang_pred == "und"
    assert got[1].lang_pred == "en" and 0 < got[1].score <= 1
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.label(docs, empty).collect()} == {"und"}
    assert langid.label(none, model).count() == 0
    kept = langid.keep_documents(docs, model)
    assert kept.columns == docs.columns
    assert {2, 3, 5}.isdisjoint(r.doc_id for r in kept.collect())


def test_decontaminate(spark, docs, none):
    item = " ".join(LONG.split()[500:540])
    bench = spark.createDataFrame([(1, item, "z"), (1, item, "z"), (2, None, "z"), (3, "", "z"), (4, "too short", "z"), (None, item, "z")], "item_id long, text string, doc_id string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 1), (4, None)}
    assert got[0].n_match == 40
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns
    assert decontaminate.drop_leaks(docs, bench).count() == len(ROWS) - 1


def test_sharding(docs, none):
    got = sharding.with_slots(sharding.assign(docs.select("doc_id", "text"), F.col("doc_id"), sharding.TREE, "shard"), "shard", ["doc_id"], 40)
    assert got.count() == len(ROWS)
    assert got.where("doc_id = 1").select("shard").distinct().count() == 1
    assert got.select("shard", "slot").distinct().count() == len(ROWS)
    assert sharding.with_slots(sharding.assign(none.select("doc_id"), F.col("doc_id"), sharding.TREE, "shard"), "shard", ["doc_id"], 40).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (4, 0, 1), (2, 0, 1), (None, 0, 1), (6, 0, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    got = toxicity.score(docs, chain).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(none, chain).count() == 0


def test_quality_fm(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (2, 0, 1), (None, 0, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    machine = quality_fm.train(docs, labels)
    got = quality_fm.score(docs, machine).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality_fm.score(docs, quality_fm.train(none, labels)).count() == len(ROWS)
    assert quality_fm.score(none, machine).count() == 0


def test_neardup(docs, none):
    got = neardup.classes(docs, neardup.Linking()).collect()
    assert len(got) == len(ROWS)
    assert {r.component_id for r in got if r.doc_id == 1} == {1}
    assert all(r.component_id == r.doc_id for r in got)
    assert [r.n_shingles for r in got if r.doc_id in (2, 3, 5)] == [0, 0, 0]
    assert neardup.classes(none, neardup.Linking()).count() == 0
    kept = neardup.keep_one(docs, neardup.Linking())
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[2].n_words == got[3].n_words == 0 and got[2].first_word is None and got[2].labels == "" and got[2].score == 0
    assert licenses.scan(none).count() == 0


def test_sentencepieces(docs, none):
    model = sentencepieces.PieceModel.load(sentencepieces.model_path())
    got = sentencepieces.encode_counts(docs, model).collect()
    assert len(got) == len(ROWS) and all(r.restored for r in got)
    assert {r.n_pieces for r in got if r.doc_id in (2, 3)} == {0}
    assert sentencepieces.encode_counts(none, model).count() == 0
    assert sentencepieces.encode(none, model).count() == 0


def test_token_counts(docs, none):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, token_counts.tokenizer_path()).collect()}
    assert got[2].n_tokens == got[3].n_tokens == got[5].n_tokens == 0
    assert token_counts.count_tokens(none, token_counts.tokenizer_path()).count() == 0
