"""The corpus operators do their whole job."""

from itertools import combinations

import numpy as np
import pytest

from waygraph.llm import decontaminate, sentencepieces


@pytest.mark.parametrize(("head", "words"), [(3, 3), (sentencepieces.HEAD, sentencepieces.BLOCK_WORDS)])
def test_pieces_are_ids_and_whole_texts(spark, head, words):
    import sentencepiece

    texts = {1: "a  b\nc é 😀   ", 2: "x ▁y", 3: None, 4: "", 5: "▁", 6: "the " * 50 + "日本語", 7: " lead"}
    model = sentencepieces.PieceModel.load(sentencepieces.model_path())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
    rows = sentencepieces.encode_counts(spark.createDataFrame([*texts.items(), (2, "x ▁y")], "doc_id long, text string"), model, head, words).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 2, 3, 4, 5, 6, 7]
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert list(r.ids) == ids and r.n_pieces == len(ids) and r.n_bytes == sum(map(library.is_byte, ids))
        assert r.decoded == library.decode(ids) and r.restored == (r.decoded == (texts[r.doc_id] or ""))
        assert r.ids_code == sum((i + 1) * pow(sentencepieces.BASE, at, sentencepieces.PRIME) for at, i in enumerate(ids)) % sentencepieces.PRIME
    assert {r.doc_id for r in rows if not r.restored} == {2, 5}


def test_longest_stretch_against_brute_force():
    rng = np.random.default_rng(5)
    item = [b"%d" % i for i in range(18)]
    for _ in range(400):
        n, diagonal = int(rng.integers(1, 40)), int(rng.integers(-6, 25))
        doc = [item[i - diagonal] if 0 <= i - diagonal < 18 and rng.random() < 0.7 else b"x" for i in range(n)]
        lo, hi = max(0, diagonal), min(n, diagonal + 18)
        same = [doc[i] == item[i - diagonal] for i in range(lo, hi)]
        every = [(b - a, sum(same[a:b]), -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 4 * sum(same[a:b]) >= 3 * (b - a)]
        size, m, a = max(every, default=(0, 0, 0))
        assert decontaminate.best_stretch(doc, item, diagonal) == (lo - a, size, m)


def test_short_items_leak_wherever_substituted(spark):
    items, docs, want = [], [], set()
    for size, most in ((13, 1), (15, 2), (16, 2), (15, 3)):
        words = [f"w{size}x{most}x{i}" for i in range(size)]
        items.append((len(items), " ".join(words)))
        for places in combinations(range(size), most):
            own = [f"s{i}" if i in places else w for i, w in enumerate(words)]
            if any(all(mask[j] == "0" or at + j not in places for j in range(len(mask))) for mask in decontaminate.MASKS for at in range(size - len(mask) + 1)):
                want.add((len(docs), items[-1][0], size, size - most))
            docs.append((len(docs), " ".join(["before"] * 9 + own + ["after"] * 9)))
    assert len(docs) == 13 + 105 + 120 + 455 and len(docs) - len(want) == 11
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_tokens, r.n_match) for r in got} == want


def test_neardup_in_a_dense_group(spark):
    """Copies of one text whose similarities lie about the threshold, changed by words that recur: all pairs against the operator."""
    from waygraph.llm import neardup

    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(400):
        rate = rng.uniform(0, 0.09)
        docs.append((d, " ".join(f"v{rng.integers(0, 4)}" if rng.random() < rate else w for w in base)))
    linking = neardup.Linking(3, 85)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in docs)]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = {d: root(d) for d, _ in docs}
    assert 20 < len(set(want.values())) < 380
    got = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string"), linking).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    bits = neardup.some_bits(rng.integers(0, 65536, (2, 128)).astype("<u2"))
    assert bits.shape == (2, 2 * neardup.BITS) and neardup.least_agreeing(linking) > 70


def test_leaks_go_row_by_row(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    other = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(None, passage, "x"), (None, "a clean text", "y"), (5, f"so {passage} it is", "z"), (5, "clean too", None), (6, other, "x"), (7, None, "x")], "doc_id long, text string, text_hash string")
    bench = spark.createDataFrame([(1, passage), (1, other), (None, " ".join(f"r{i}" for i in range(14)))], "item_id long, text string")
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == ["", "a clean text", "clean too"]
    got = decontaminate.find_leaks(docs.union(spark.createDataFrame([(9, " ".join(f"r{i}" for i in range(14)), "")], docs.schema)), bench)
    assert {(r.doc_id, r.item_id, r.n_tokens) for r in got.collect()} == {(None, 1, 20), (5, 1, 20), (6, 1, 20), (9, None, 14)}


def test_more_languages_than_are_learned(spark):
    from waygraph.llm import langid

    rows = [(i, f"alpha beta gamma {chr(97 + i % 26)}{i}", f"l{i % 70:02}") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == langid.MAX_LANGS


def test_training_rows_are_bounded(spark):
    from waygraph.llm import common

    docs = spark.createDataFrame([(i % 50, f"text {i} " * 40) for i in range(5000)] + [(1, "same")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert 300 < len(common.training_rows(docs, labels, "toxic", ["text"], 1000, 10**9, 3)["text"]) < 1300
    assert sum(map(len, common.training_rows(docs, labels, "toxic", ["text"], 10**6, 100_000, 3)["text"])) < 150_000


def test_shards_against_draws_in_python(spark):
    """The tree's draws, by the hash's own library."""
    import math

    import xxhash
    from pyspark.sql import functions as F

    from waygraph.llm import sharding

    tree = sharding.ShardTree((((1.0, 3.0), (2.0,)), ((2.0, 0.5), (2.0, 1.0, 1.0)))).grow(1.5)

    def draw(key, child, weight, size):
        h = xxhash.xxh64_intdigest(child.to_bytes(size, "little"), xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42))
        return -math.log(((h & (1 << 52) - 1) + 0.5) / (1 << 52)) / weight

    def shard(key):
        least = lambda level, parent, weights: min((draw(key, level * 1_000_003 + parent * 1_009 + c, w, 4), c) for c, w in enumerate(weights) if w > 0)
        d1, r = least(1, 0, [sum(map(sum, region)) for region in tree.regions])
        d2, k = least(2, r, list(map(sum, tree.regions[r])))
        rack = sum(len(x) for x in tree.regions[:r]) + k
        d3, s = least(3, rack, tree.regions[r][k])
        extra = draw(key, 9_000_000_007, 1.5, 8)
        first = sum(len(x) for region in tree.regions[:r] for x in region) + sum(map(len, tree.regions[r][:k]))
        return tree.n_base if extra < d1 else first + s

    got = sharding.assign(spark.range(500).select(F.col("id").alias("key")), F.col("key"), tree, "shard").collect()
    assert {r.key: r.shard for r in got} == {i: shard(i) for i in range(500)}


def test_changed_weights_move_rows_only_into_their_subtree(spark):
    from pyspark.sql import functions as F

    from waygraph.llm import sharding

    old = sharding.ShardTree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    new = sharding.ShardTree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 2.0), (1.0, 1.0))))
    rows = spark.range(4000).select(F.col("id").alias("key"))
    rows = sharding.assign(sharding.assign(rows, F.col("key"), old, "a", path=True).withColumnsRenamed({"region": "ra", "rack": "ka"}), F.col("key"), new, "b", path=True)
    moved = rows.where("a <> b").collect()
    assert 100 < len(moved) < 800
    # into the region from the other one, into the rack from its neighbour, or into the shard itself
    assert all(r.region == 1 for r in moved) and all(r.rack == 2 for r in moved if r.ra == 1) and all(r.b == 5 for r in moved if r.ka == 2)


def test_equal_rows_get_slots_of_their_own(spark):
    from waygraph.llm import sharding

    rows = spark.createDataFrame([(7, 1, 0)] * 300 + [(8, 1, 1)] * 5, "doc_id long, text_crc32 long, shard int")
    got = sharding.with_slots(rows, "shard", ["doc_id", "text_crc32"], 2).collect()
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(300)) and sorted(r.slot for r in got if r.shard == 1) == list(range(5))
