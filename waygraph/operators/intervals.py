"""Facts that hold for a while: the frames that they hold in, their present time, and what their evidence says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of time that intervals and frames meet in.
BUCKET_US = 8_000_000
#: Columns of evidence that name the present observation, in the order of their say.
PRESENT = "current_timestamp_us bigint, current_time_us bigint, current_entity_id string, current_pair_id string"
#: Evidence of the families that tables are made of.
EVIDENCE = {"follows": "gap double, duration_s double", "queuesBehind": "gap double, duration_s double", "crossesInFrontOf": "conflict_x double, conflict_y double, angle double, s_eta double, eta_gap double, score double"}


def at_frames(events: DataFrame, frames: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """events (scenario_token, start_us, end_us, ...) once for each frame in their interval, with frame_index and timestamp_us.

    An interval goes to all buckets of time that it touches, a frame lies in one: an
    equi-join on scenario and bucket, of which the interval's ends are then asked.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_us)
    spread = events.drop("frame_index", "timestamp_us").withColumn("bucket", F.explode(F.sequence(bucket("start_us"), bucket("end_us"))))
    own = frames.select("scenario_token", "frame_index", "timestamp_us", bucket("timestamp_us").alias("bucket"))
    return spread.join(own, ["scenario_token", "bucket"]).where(F.col("timestamp_us").between(F.col("start_us"), F.col("end_us"))).drop("bucket")


def together(events: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Pairs of events (scenario_token, predicate, s_track, o_track, start_us, end_us) of one subject that overlap in time: first, second, from_us, to_us.

    Both sides go to their buckets; of those that both share the first counts.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_us)
    own = ("predicate", "o_track", "start_us", "end_us")
    side = lambda p: events.withColumn("bucket", F.explode(F.sequence(bucket("start_us"), bucket("end_us")))).select("scenario_token", "s_track", "bucket", *(F.col(c).alias(f"{p}_{c}") for c in own))
    both = side("a").join(side("b"), ["scenario_token", "s_track", "bucket"])
    both = both.where(F.col("bucket") == F.greatest(bucket("a_start_us"), bucket("b_start_us")))
    both = both.where((F.struct("a_predicate", "a_o_track", "a_start_us") < F.struct("b_predicate", "b_o_track", "b_start_us")) & (F.col("a_start_us") <= F.col("b_end_us")) & (F.col("b_start_us") <= F.col("a_end_us")))
    name = lambda p: F.concat_ws(" ", f"{p}_predicate", f"{p}_o_track")
    return both.select("scenario_token", "s_track", name("a").alias("first"), name("b").alias("second"), F.greatest("a_start_us", "b_start_us").alias("from_us"), F.least("a_end_us", "b_end_us").alias("to_us"))


def runs(facts: DataFrame) -> DataFrame:
    """Facts of frames that name the start of their run (start_us) as one row a run, with its end."""
    return facts.groupBy("scenario_token", "predicate", "s_track", "o_track", "start_us").agg(F.max("timestamp_us").alias("end_us"))


def edges_at_frames(events: DataFrame, stated: DataFrame, frames: DataFrame) -> DataFrame:
    """Edges (scenario_token, frame_index, timestamp_us, predicate, s_track, o_track) of events in all frames that they hold in, less those that are stated there anyhow."""
    key = ["scenario_token", "frame_index", "predicate", "s_track", "o_track"]
    held = at_frames(events, frames).select("timestamp_us", *key).distinct()
    return held.join(stated.select(*key), key, "left_anti")


def time_in_id(node: Column) -> Column:
    """Time of the observation that a name is of: pairs have it inside, road users at the end; null where a name has none."""
    pair = F.regexp_extract(node, r"^pair:.*:(\d+):(?:ego_to_agent|agent_to_ego|agent_to_agent|agent_to_agent_reverse):[0-9a-f]+$", 1)
    user = F.regexp_extract(node, r"^(?:ego|agent):.*:(\d+)$", 1)
    return F.coalesce(F.nullif(pair, F.lit("")), F.nullif(user, F.lit(""))).cast("bigint")


def track_in_id(node: Column) -> Column:
    return F.when(node.startswith("ego:"), "ego").otherwise(F.nullif(F.regexp_extract(node, r"^agent:.*:([^:]*):\d+$", 1), F.lit("")))


def current_time(asserted: DataFrame) -> DataFrame:
    """asserted with current_us: the time of the frame that a fact was stated in.

    Its end; where it has none the time of its provenance, then the times and names that its
    evidence calls current, then the name of its subject where that is a pair, its object, its subject, and last its start.
    """
    said = F.from_json(F.coalesce("evidence", F.lit("{}")), PRESENT)
    given = [F.col(c) for c in ("end_us", "provenance_us") if c in asserted.columns]
    pair = F.when(F.col("subject_id").startswith("pair:"), time_in_id(F.col("subject_id")))
    chain = [*given, said["current_timestamp_us"], said["current_time_us"], time_in_id(said["current_entity_id"]), time_in_id(said["current_pair_id"]), pair, time_in_id(F.col("object_id")), time_in_id(F.col("subject_id")), F.col("start_us")]
    return asserted.withColumn("current_us", F.coalesce(*chain))


def evidence_table(asserted: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """Facts of predicates that share a schema of evidence, with its fields as columns, and the tracks of both ends."""
    kinds = {EVIDENCE[p] for p in predicates}
    if len(kinds) != 1:
        raise ValueError(f"{', '.join(predicates)} don't have evidence of one kind")
    facts = current_time(asserted.where(F.col("predicate").isin(*predicates))).withColumn("said", F.from_json("evidence", kinds.pop()))
    return facts.select("scenario_token", "current_us", "predicate", track_in_id(F.col("subject_id")).alias("s_track"), track_in_id(F.col("object_id")).alias("o_track"), "start_us", "said.*")
