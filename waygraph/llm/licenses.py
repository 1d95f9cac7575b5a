"""Licence scans: exact phrases and fuzzy short notices.

A notice with at most k edits is split into k + 1 seeds; by the pigeonhole
principle a place that matches within k edits holds at least one seed exactly.
One automaton finds all seeds in the normalised words; around each seed the regex
library verifies the whole notice with bounded errors and reports spans.  The words
that tell a licence from others must stand as they are; edits fall on the rest.

Defined results: a null text is empty; texts without words have counts of 0, null
places, empty labels and score 0; repeated rows are scanned one by one; other
columns aren't read.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import map_arrow, table

#: The phrases that are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices, their labels, the edits each may hold, and the words that must be exact.
NOTICES = (
    ("released under the mit license", "mit", 3, "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8, ""),
    ("licensed under the apache license version 2 0", "apache", 4, "apache"),
    ("this work is licensed under the gnu general public license version", "gpl", 6, "gnu general"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 12, "gnu general"),
    ("gnu lesser general public license", "lgpl", 3, "lesser"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 9, ""),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", 7, "mozilla"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 7, ""),
    ("this work is licensed under a creative commons attribution", "cc", 5, "creative commons"),
    ("spdx license identifier mit", "mit", 2, "mit"),
    ("spdx license identifier apache 2 0", "apache", 3, "apache"),
    ("all rights reserved", "reserved", 1, ""),
)
#: Every ASCII character but digits and letters parts words; A-Z are lower-cased first.
SPLIT = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(SPLIT).split() if text else []


def places(line: bytes, phrase: bytes) -> list[int]:
    """Offsets of the phrase in a line of words that begins and ends with a space; neighbours may share theirs."""
    out, at = [], line.find(b" " + phrase + b" ")
    while at >= 0:
        out.append(at)
        at = line.find(b" " + phrase + b" ", at + 1)
    return out


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of the notice with their offsets."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeFinder:
    """Finds notices in a line of words by seeds, then verifies them."""

    def __init__(self, notices=NOTICES) -> None:
        import ahocorasick

        self.notices = [(n, label, k, regex.compile(rf"(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}", regex.BESTMATCH)) for n, label, k, _ in notices]
        self.exact = [f" {e} " if e else "" for *_, e in notices]
        parts: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k, _) in enumerate(notices):
            for at, seed in seeds(n, k):
                parts.setdefault(seed, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for seed, owners in parts.items():
            self.automaton.add_word(seed, (len(seed), owners))
        self.automaton.make_automaton()

    def find(self, line: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of matches that don't overlap another of the same notice with fewer edits."""
        begins: dict[int, list[int]] = {}
        for end, (size, owners) in self.automaton.iter(line):
            for i, at in owners:
                begins.setdefault(i, []).append(end + 1 - size - at)
        found = []
        for i, each in begins.items():
            n, _, k, pattern = self.notices[i]
            grams = {n[j : j + 3] for j in range(len(n) - 2)}
            each.sort()
            matches, at = set(), 0
            while at < len(each):
                # seeds of one place put its begin at most 2 k apart; a window stays of bounded length
                first = each[at]
                while at < len(each) and each[at] - first <= 2 * k:
                    at += 1
                lo, hi = max(0, first - k), each[at - 1] + len(n) + k
                # each edit spoils three trigrams at most
                if len(n) - 2 - 3 * k > 0 and not self.enough(line[lo:hi], grams, len(grams) - 3 * k):
                    continue
                if (m := pattern.search(line, lo, min(hi, len(line)))) and self.exact[i] in self.words_about(line, m.start(), m.end()):
                    matches.add((sum(m.fuzzy_counts), m.start(), m.end()))
            own: list[tuple[int, int]] = []
            for edits, a, b in sorted(matches):
                place = bisect.bisect(own, (a, b))
                if (place == 0 or own[place - 1][1] <= a) and (place == len(own) or b <= own[place][0]):
                    own.insert(place, (a, b))
                    found.append((i, a, b, edits))
        return found

    @staticmethod
    def words_about(line: str, a: int, b: int) -> str:
        """A stretch of the line, up to the ends of its first and last words, between spaces."""
        before, after = line.rfind(" ", 0, a + 1), line.find(" ", b - 1)
        return line[max(0, before) : after + 1 if after >= 0 else len(line)]

    @staticmethod
    def enough(part: str, grams: set[str], need: int) -> bool:
        return len(grams.intersection(part[j : j + 3] for j in range(len(part) - 2))) >= need


def scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: label, first word, words, edits."""
    state: dict = {}

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        finder: NoticeFinder = state.setdefault("f", NoticeFinder(notices))
        rows: list[tuple] = []
        for text in cols["text"]:
            words = words_of(text)
            raw = b" " + b" ".join(words) + b" "
            at, base = [], set()
            if b" license " in raw:
                for phrase, label in PHRASES:
                    if got := places(raw, phrase.encode()):
                        base.add(label)
                        at += got
                if at:
                    first = np.cumsum([1, *(len(w) + 1 for w in words)])
                    at = np.searchsorted(first, np.array(at) + 1).tolist()
            line = raw.decode("utf-8", "surrogatepass")
            spans, best = [], 1.0 if base else 0.0
            hits = finder.find(line) if words else []
            blanks = np.array([m.start() for m in re.finditer(" ", line)]) if hits else ()
            for i, a, b, edits in hits:
                n, label, _, _ = finder.notices[i]
                spans.append({"label": label, "first": int(np.searchsorted(blanks, a + (line[a] == " "))) - 1, "words": len(line[a:b].split()), "edits": edits})
                best = max(best, 1 - edits / len(n))
            labels = base | {s["label"] for s in spans}
            rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, sorted(spans, key=lambda s: (s["first"], s["label"], s["words"]))))
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
        return {"doc_id": cols["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    slim = docs.select("doc_id", "text")
    kind = dict(slim.dtypes)["doc_id"]
    return map_arrow(slim, kernel, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:int,words:int,edits:int>>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("n_notices", F.size("spans").cast("long")).drop("spans")
