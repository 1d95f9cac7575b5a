"""The pipeline's stages, each against a plain version on its own input."""

import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fails(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    return len(w) < 10 or 100 * len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}) > 20 * len(w)


def least_of_classes(texts):
    sets = {d: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(words(t.translate(LOWER))) for d, t in texts.items()}
    group = {d: {d} for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and group[a] is not group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    return {min(g) for g in group.values()}


def test_stages(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from waygraph.llm import licenses, sentencepieces

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        given, docs = docs, spark.read.parquet(str(tmp_path / name))
        texts, kept = {r.doc_id: r.text for r in given.collect()}, {r.doc_id for r in docs.collect()}
        seen.append((name, len(texts), len(kept)))
        if name != "pieces":
            assert docs.columns == columns
        if name == "language":
            assert len(kept) >= 0.97 * len(texts)
        elif name == "quality":
            assert kept == {d for d, t in texts.items() if not fails(t)}
        elif name == "near_duplicates":
            assert kept == least_of_classes(texts)
        elif name == "decontamination":
            line = lambda t: " " + " ".join(w.decode() for w in licenses.words_of(t)) + " "
            items = [line(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = {d for d, t in texts.items() if any(i in line(t) for i in items)}
            assert not kept & leaks and len(set(texts) - kept - leaks) <= 2
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
            assert {r.doc_id: r.n_pieces for r in docs.collect()} == {d: len(library.encode(t)) for d, t in texts.items()}
    assert [s[0] for s in seen] == ["language", "quality", "near_duplicates", "decontamination", "pieces"]


@pytest.mark.parametrize("column", ["doc_id", "text", "lang", "source", "n_chars"])
def test_stages_take_nulls(spark, column):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    holed = docs.withColumn(column, F.when(F.rand(3) < 0.5, F.col(column)))
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, holed, SF).count() <= 12


CLASHING = ("key", "label", "row", "__hash", "component_id", "kept", "score", "registers")


@pytest.mark.parametrize("case", ["empty", "nulls", "repeated"])
def test_whole_runs(spark, tmp_path, case):
    """From the documents to their pieces, on no rows, on rows with holes in all columns, and on rows that each come twice, with clashing columns."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    whole = docs
    if case == "empty":
        docs = docs.limit(0)
    elif case == "nulls":
        for i, c in enumerate(docs.columns):
            docs = docs.withColumn(c, F.when(F.xxhash64(F.lit(i), "n_chars" if c != "n_chars" else "text") % 4 != 0, F.col(c)))
    else:
        docs = docs.unionByName(docs)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if case == "empty":
        assert got == []
    elif case == "nulls":
        assert 0 < len(got) < 40 and all(r.n_pieces > 0 for r in got)
    else:
        whole.write.parquet(str(tmp_path / "once" / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "once" / "benchmark.parquet"))
        once = corpus_pipeline.run(spark, str(tmp_path / "once")).collect()
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in once)


def test_language_stage_is_a_plain_viterbi(spark):
    """Labels and scores of every text by loops over words and languages, from the model's scores of single words."""
    import numpy as np

    from waygraph.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    model = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.label(docs, model, spans=False).collect()}
    for r in docs.collect():
        own = (r.text or "").split()
        scores, letters = model.score(own) if own else (np.zeros((0, 1)), np.zeros(0))
        if letters.sum() == 0:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        value, back = [float(x) for x in scores[0]], []
        for s in scores[1:]:
            top = max(range(len(value)), key=lambda k: value[k])
            jump = value[top] - langid.SWITCH
            back.append([k if value[k] >= jump else top for k in range(len(value))])
            value = [max(value[k], jump) + float(s[k]) for k in range(len(value))]
        at = max(range(len(value)), key=lambda k: value[k])
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        path.reverse()
        share = [sum(n for n, p in zip(letters, path, strict=True) if p == k) for k in range(len(model.langs))]
        lang = share.index(max(share))
        score = sum(float(np.exp(s[lang])) * n for s, n, p in zip(scores, letters, path, strict=True) if p == lang) / letters.sum()
        assert got[r.doc_id] == (model.langs[lang], pytest.approx(score, abs=1e-3))
