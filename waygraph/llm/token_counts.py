"""Token counts with a public tokenizer, by overlap resynchronisation for huge documents.

A document of at most CHUNK characters is counted whole.  A longer one is
encoded in chunks that overlap, with offsets.  Two neighbours are spliced at a
place in the overlap that is proven stable: the character before it is ASCII white
space, which the pre-tokenizer drops and which no piece, normalisation or special
string spans, and both encodings have a token that begins there.  Where the
overlap holds no such place, it is widened, up to the rest of the document.

White space is just as stable in documents counted whole: their count is the sum
over the words between ASCII white space, and each word that a task has not met
yet is encoded by the library.

Defined results: a null or empty text has no tokens; repeated rows are counted
one by one; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import map_arrow, table

CHUNK = 32_768
OVERLAP = 512
LIMIT = 2048
#: Words whose counts a task keeps; past that it starts afresh.
KEPT_WORDS = 500_000
ASCII_SPACE = " \t\n\r\x0b\x0c"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def stable_splice(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], lo: int, hi: int) -> int | None:
    """The last place in [lo, hi) after white space where a token of both encodings begins; offsets are of the whole text."""
    starts = {a for a, _ in left if lo <= a < hi}
    common = [a for a, _ in right if lo <= a < hi and a in starts and a > 0 and text[a - 1] in ASCII_SPACE]
    return max(common, default=None)


def chunked_offsets(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Token offsets of a text of any length; encode gives the offsets of a short one."""
    shifted = lambda a, b: [(x + a, y + a) for x, y in encode(text[a:b])]
    begin, end = 0, min(chunk, len(text))
    done: list[tuple[int, int]] = []
    held = shifted(begin, end)
    while end < len(text):
        wide = overlap
        while True:
            lo = max(begin, end - wide)
            nxt = min(len(text), lo + max(chunk, 2 * wide))
            new = shifted(lo, nxt)
            at = stable_splice(text, held, new, lo + 1, end)
            if at is not None:
                done += [x for x in held if x[0] < at]
                held, begin, end = [x for x in new if x[0] >= at], at, nxt
                break
            if lo == begin:  # no stable place in the whole chunk: widen it to the right, then to the rest
                end = min(len(text), end + max(chunk, end - begin))
                held = shifted(begin, end)
                if end == len(text):
                    break
                wide = overlap
                continue
            wide *= 4
    return done + held


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks. path must name the file on every executor; the library's file is installed with it."""
    state: dict = {}

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        if not state:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            state["t"], state["n"] = Tokenizer.from_file(path), {}
            state["t"].no_truncation()
            state["t"].no_padding()
        tok, known = state["t"], state["n"]
        n_bytes, n_tokens, n_chunks = [], [], []
        short: list[tuple[int, list[bytes]]] = []
        fresh: set[bytes] = set()

        def settle() -> None:
            todo = list(fresh)
            for i in range(0, len(todo), 4096):
                part = todo[i : i + 4096]
                for w, e in zip(part, tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                    known[w] = len(e.ids)
            for row, words in short:
                n_tokens[row] = sum(map(known.__getitem__, words))
            short.clear()
            fresh.clear()
            if len(known) > KEPT_WORDS:
                known.clear()

        pending = 0
        for text in cols["text"]:
            text = text or ""
            raw = text.encode()
            n_bytes.append(len(raw))
            if len(text) > chunk:
                offsets = chunked_offsets(text, lambda s: tok.encode(s, add_special_tokens=False).offsets, chunk, overlap)
                n_tokens.append(len(offsets))
                n_chunks.append(-(-len(text) // chunk))
                continue
            words = raw.split()
            fresh.update(w for w in words if w not in known)
            short.append((len(n_tokens), words))
            n_tokens.append(0)
            n_chunks.append(1)
            pending += len(words)
            if pending > 300_000:
                settle()
                pending = 0
        settle()
        return {"doc_id": cols["doc_id"], "n_bytes": n_bytes, "n_tokens": n_tokens, "n_chunks": n_chunks}

    slim = docs.select("doc_id", "text")
    return map_arrow(slim, kernel, f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, n_chunks bigint")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
