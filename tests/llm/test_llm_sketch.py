"""Registers by one product a draw, and word codes worked out once a word."""

import numpy as np

from waygraph.llm import neardup


def test_a_words_code_is_worked_out_once_and_the_store_stays_bounded(monkeypatch):
    known = neardup.Words()
    codes = known.of([b"a", b"b", b"a"])
    assert codes[0] == codes[2] != codes[1] and len(known) == 2
    monkeypatch.setattr(neardup, "KEPT_WORDS", 1)
    assert known.of([b"a"])[0] == codes[0] and len(known) == 1


def test_registers_agree_as_often_as_sets_share_and_merge_to_the_union():
    rng, seeds = np.random.default_rng(5), neardup.seeds()
    for n in (200, 3000):
        same = []
        for _ in range(40):
            words = rng.integers(0, 2**63, n).astype(np.uint64)
            u = neardup.shingle_codes(words, 1)
            shared, rest = round(0.8 * len(u)), round(0.1 * len(u))
            a, b = u[: shared + rest], np.concatenate([u[:shared], u[shared + rest :]])
            x, y = neardup.sketch(a, seeds), neardup.sketch(b, seeds)
            assert (neardup.merge(x, y) == neardup.sketch(np.union1d(a, b), seeds)).all()
            same.append((x == y).mean())
        assert abs(np.mean(same) - 0.8) < 0.02
