"""One table of all facts: who states what of whom, when it holds, and what it rests on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.operators.entities import entity_id

#: Columns of an assertion before it has its id and its category.
COLUMNS = {
    "scenario_token": "string", "timestamp_us": "bigint", "predicate": "string", "subject_id": "string", "object_id": "string",
    "value": "string", "number": "double", "start_us": "bigint", "end_us": "bigint", "evidence": "string",
}


def entity(track: str) -> Column:
    """Name of the state that a track has in the row's frame."""
    return entity_id(F.col("scenario_token"), F.col(track), F.col("timestamp_us"), F.col(track) == "ego")


def stated(df: DataFrame, subject: Column, object_id: Column | None = None, value: Column | None = None, number: Column | None = None, start: Column | None = None, end: Column | None = None, evidence: Iterable[str] = ()) -> DataFrame:
    """Facts (scenario_token, timestamp_us, predicate, ...) in the common form.

    A fact without an end holds at its time alone.  evidence names the columns that
    the JSON of the fact keeps; nulls are left out of it.
    """
    given = {"subject_id": subject, "object_id": object_id, "value": value, "number": number, "start_us": F.col("timestamp_us") if start is None else start, "end_us": F.col("timestamp_us") if end is None else end}
    given["evidence"] = F.to_json(F.struct(*evidence)) if evidence else None
    return df.select(*((F.col(c) if c not in given else F.lit(None) if given[c] is None else given[c]).cast(kind).alias(c) for c, kind in COLUMNS.items()))


def of_entities(df: DataFrame) -> DataFrame:
    """Facts of KEYS with a predicate and, where there is one, a value (number) or an object (text)."""
    return stated(df, entity("track_token"), value=F.col("object") if "object" in df.columns else None, number=F.col("value") if "value" in df.columns else None)


def of_pairs(df: DataFrame, evidence: Iterable[str] = ()) -> DataFrame:
    """Facts of s_track about o_track with a predicate and, where there is one, a value (number) or an object (text)."""
    return stated(df, entity("s_track"), entity("o_track"), value=F.col("object") if "object" in df.columns else None, number=F.col("value") if "value" in df.columns else None, evidence=evidence)


def united(families: Iterable[DataFrame]) -> DataFrame:
    """All facts behind each other; each is stated once, so that nothing is shuffled."""
    families = iter(families)
    out = next(families)
    for more in families:
        out = out.unionByName(more)
    return out


def identified(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Facts of the catalogue with assertion_id, category and value_type; equal facts have one id."""
    text = {"number": F.col("number").cast("decimal(38,6)").cast("string")}
    parts = [F.coalesce(text.get(c, F.col(c).cast("string")), F.lit("~")) for c in ("scenario_token", "timestamp_us", "predicate", "subject_id", "object_id", "value", "number", "start_us", "end_us")]
    named = facts.withColumn("assertion_id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))
    return named.join(F.broadcast(definitions.select("predicate", "category", "value_type")), "predicate").select("assertion_id", "category", "value_type", *COLUMNS)


def deduplicated(asserted: DataFrame) -> DataFrame:
    """One row for each id."""
    return asserted.dropDuplicates(["assertion_id"])


def holding_at(asserted: DataFrame, scenario: str, time_us: int) -> DataFrame:
    """Facts that hold at a time, instants and intervals."""
    return asserted.where((F.col("scenario_token") == scenario) & F.lit(time_us).between(F.col("start_us"), F.col("end_us")))


def selected(asserted: DataFrame, scenarios: tuple[str, ...] = (), categories: tuple[str, ...] = (), predicates: tuple[str, ...] = (), first_us: int | None = None, last_us: int | None = None) -> DataFrame:
    """Facts of some scenarios, categories and predicates that hold at some time of a span; what isn't given isn't asked."""
    for column, values in (("scenario_token", scenarios), ("category", categories), ("predicate", predicates)):
        if values:
            asserted = asserted.where(F.col(column).isin(*values))
    if first_us is not None:
        asserted = asserted.where(F.col("end_us") >= first_us)
    return asserted if last_us is None else asserted.where(F.col("start_us") <= last_us)


def about(asserted: DataFrame, kinds: tuple[str, ...], entities: DataFrame) -> DataFrame:
    """Facts whose subject is a road user of some types (agent_type of the canonical entities)."""
    named = entities.where(F.upper("agent_type").isin(*kinds)).select(entity("track_token").alias("subject_id"))
    return asserted.join(named, "subject_id", "left_semi")


def in_both(one: DataFrame, other: DataFrame) -> DataFrame:
    """Facts of one run that the other states too."""
    return one.join(other.select("assertion_id"), "assertion_id", "left_semi")


def only_in(one: DataFrame, other: DataFrame) -> DataFrame:
    """Facts of one run that the other doesn't state."""
    return one.join(other.select("assertion_id"), "assertion_id", "left_anti")


def with_pairs(asserted: DataFrame, members: DataFrame) -> DataFrame:
    """asserted with member_subject and member_object: of facts whose subject is a pair, its members (pair_id, s_id, o_id); else null."""
    named = members.select(F.col("pair_id").alias("subject_id"), F.col("s_id").alias("member_subject"), F.col("o_id").alias("member_object"))
    return asserted.join(named, "subject_id", "left")
