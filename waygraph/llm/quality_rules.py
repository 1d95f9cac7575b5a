"""Quality rules: per-document failures, gathered by host and shrunk by an empirical beta prior.

Each document gets word and line counts and rule failures.  Failures are
summed by host; a host's failure rate for a rule is (failed + a) / (n + a + b),
where the beta prior (a, b) is fitted by moments to all hosts, so that a host of
few documents stays near the corpus.  A host whose shrunken rate of any rule
exceeds the limit is rejected, and its verdict is joined back to its documents.

Defined results: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows are judged one by one; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import add_arrow, map_arrow, materialize, table, words_of

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
#: Shrunken rate of failing documents above which a host is rejected.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight in documents.
PRIOR = (2.0, 10_000.0)
#: Hosts up to this count are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 100_000
RULES = ("base", "symbols", "lines")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen: dict[tuple, int] = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = upto = 0
    for at, g in enumerate(grams):
        if seen[g] > 1:
            covered += at + window - max(at, upto)
            upto = at + window
    return covered


def rule_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _kernel(cols: dict[str, list]) -> dict[str, list]:
    rows = [rule_counts(t) for t in cols["text"]]
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return {k: v for k, v in cols.items() if k != "text"} | {n: [r[i] for r in rows] for i, n in enumerate(names)}


def failures() -> dict[str, F.Column]:
    """Rule name to failure, over the columns of COUNTS."""
    return {
        "base": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "symbols": 100 * F.col("n_symbols") > 40 * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
    }


def host_verdicts(counted: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """host, host_docs, host_rate (the worst rule's shrunken rate), host_rejected; counted has host and COUNTS."""
    rules = failures()
    hosts = counted.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c.cast("long")).alias(f"f_{r}") for r, c in rules.items()))
    totals = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"f_{r}").alias(f"f_{r}") for r in rules), *(F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}") for r in rules)).first()
    rates = []
    for r in rules:
        n = totals["n"] or 1
        mean = (totals[f"f_{r}"] or 0) / n
        spread = max((totals[f"q_{r}"] or 0) / n - mean * mean, 0.0)
        weight = mean * (1 - mean) / spread - 1 if spread > 1e-12 else PRIOR[1]
        weight = min(max(weight, PRIOR[0]), PRIOR[1])
        rates.append((F.col(f"f_{r}") + mean * weight) / (F.col("n") + weight))
    return hosts.select("host", F.col("n").alias("host_docs"), F.greatest(*rates).alias("host_rate")).withColumn("host_rejected", F.col("host_rate") > limit)


def _with_verdicts(rows: DataFrame, counted: DataFrame, host: str) -> DataFrame:
    """rows with base_failed, host_rejected and kept; the host table is small unless hosts abound."""
    verdicts = materialize(host_verdicts(counted, host), "hosts")
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    out = rows.join(verdicts, rows[host].eqNullSafe(verdicts["host"]), "left").drop("host")
    base = failures()["base"]
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce(F.col("host_rejected"), F.lit(False)))


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host column, COUNTS, host_docs, host_rate, host_rejected, base_failed, kept."""
    slim = docs.select("doc_id", host, "text")
    kinds = dict(slim.dtypes)
    counted = materialize(map_arrow(slim, _kernel, f"doc_id {kinds['doc_id']}, `{host}` {kinds[host]}, {COUNTS}"), "rules")
    return _with_verdicts(counted, counted, host)


def keep_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    slim = docs.select(host, "text")
    counted = map_arrow(slim, _kernel, f"`{host}` {dict(slim.dtypes)[host]}, {COUNTS}")
    inner = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    text, key = inner["text"], inner[host]
    rows = add_arrow(renamed, [text], lambda cols: _kernel({"text": cols[text]}), COUNTS)
    kept = _with_verdicts(rows, materialize(counted, "rules"), key) if key == host else _with_verdicts(rows, materialize(counted.withColumnRenamed(host, key), "rules"), key)
    return kept.where("kept").select(*(F.col(n).alias(c) for c, n in inner.items()))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"
    )


SQL = r"""
with d as (select row_number() over () as row, doc_id, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
g as (select row, i, words[i : i + 4] as gram from w, unnest(range(1, len(words) - 3)) t(i) where len(words) >= 5),
r as (select row, i from (select *, count(*) over (partition by row, gram) as n from g) where n > 1),
v as (select row, count(distinct i + j) as n from r, range(0, 5) u(j) group by row),
c as (select w.doc_id, w.source, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, len(lines) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(v.n, 0) as bigint) as n_repeat_words
    from w left join v on w.row = v.row),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, 100 * n_symbols > 40 * word_chars as symbols_failed, 100 * n_dup_lines > 50 * n_lines as lines_failed from c),
h as (select source, count(*) as n, unnest([sum(base_failed :: int), sum(symbols_failed :: int), sum(lines_failed :: int)]) as bad, unnest([1, 2, 3]) as rule from f group by source),
t as (select rule, sum(bad) / sum(n) as mean, greatest(sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) * (sum(bad) / sum(n)), 0) as spread from h group by rule),
p as (select rule, mean, least(greatest(case when spread > 1e-12 then mean * (1 - mean) / spread - 1 else 10000 end, 2), 10000) as weight from t),
x as (select source, max((bad + mean * weight) / (n + weight)) > 0.5 as host_rejected from h join p using (rule) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_rejected as kept, host_rejected
from f join x on f.source is not distinct from x.source
"""
