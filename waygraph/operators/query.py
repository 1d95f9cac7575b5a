"""Reading the facts: at a time, as edges, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.operators.entities import entity_id
from waygraph.operators.intervals import track_in_id
from waygraph.operators.pairs import pair_id


def pair_edges(facts: DataFrame) -> DataFrame:
    """One edge per frame and directed pair with its sorted set of predicates."""
    return facts.groupBy("scenario_token", "frame_index", "timestamp_us", "s_track", "o_track").agg(F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"), F.count_distinct("predicate").alias("n_predicates"))


def pair_members(pairs: DataFrame) -> DataFrame:
    """pair_id, tag, member_subject, member_object: who the two of a pair are, by their names in the frame."""
    at = (F.col("scenario_token"), F.col("timestamp_us"))
    named = lambda track: entity_id(F.col("scenario_token"), F.col(track), F.col("timestamp_us"), F.col(track) == "ego")
    return pairs.select(pair_id(*at, F.col("tag"), F.col("s_track"), F.col("o_track")).alias("pair_id"), "tag", named("s_track").alias("member_subject"), named("o_track").alias("member_object"))


def semantic_edges(asserted: DataFrame, members: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """One edge a time, relation, category and directed pair of nodes with its sorted predicates and a statement.

    A fact about a pair becomes one between its members; facts whose object is no node
    are left out.  The relation is the pair's tag, or the kinds of both nodes.
    """
    facts = asserted.where(~F.col("predicate").isin("pairSubject", "pairObject")).join(members.withColumnRenamed("pair_id", "subject_id"), "subject_id", "left")
    facts = facts.where(F.col("tag").isNotNull() | (entity_kind(F.col("object_id")) != "other"))
    ends = facts.withColumns({"source": F.coalesce("member_subject", "subject_id"), "target": F.coalesce("member_object", "object_id")})
    ends = ends.withColumn("relation", F.coalesce("tag", F.concat(entity_kind(F.col("source")), F.lit("_to_"), entity_kind(F.col("target")))))
    if relations:
        ends = ends.where(F.col("relation").isin(*relations))
    edges = ends.groupBy("scenario_token", "timestamp_us", "relation", "category", "source", "target").agg(F.array_sort(F.collect_set("predicate")).alias("stated"))
    short = lambda node: F.coalesce(track_in_id(F.col(node)), F.col(node))
    statement = F.concat(short("source"), F.lit(" > "), short("target"), F.lit(": "), F.array_join("stated", ", "))
    return edges.select("scenario_token", "timestamp_us", "relation", "category", "source", "target", F.array_join("stated", ",").alias("predicates"), F.size("stated").alias("n_predicates"), statement.alias("statement"))


def collapse(edges: DataFrame, apart: tuple[str, ...] = ("follows", "overtakes", "yieldsTo")) -> DataFrame:
    """Edges regrouped so that each predicate of `apart` is an edge of its own."""
    each = edges.select("*", F.explode(F.split("predicates", ",")).alias("p")).withColumn("part", F.when(F.col("p").isin(*apart), F.col("p")).otherwise("rest"))
    return each.groupBy("scenario_token", "frame_index", "timestamp_us", "s_track", "o_track", "part").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("predicates"))


def tally(facts: DataFrame) -> DataFrame:
    """predicate, n: how often each is stated; facts that are counted already stay as they are."""
    return facts if facts.columns == ["predicate", "n"] else facts.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def counts(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """predicate, category, n: how often each is stated, most frequent first; the catalogue is small and joins by broadcast."""
    return tally(facts).join(definitions.select("predicate", "category"), "predicate", "left").select("predicate", "n", "category").orderBy(F.desc("n"), "predicate")


def coverage(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """predicate, status, n, covered: each predicate of the catalogue, how often it is stated, and whether all enabled ones are."""
    each = definitions.select("predicate", "status").join(tally(facts), "predicate", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return each.withColumn("covered", (F.col("n") > 0) | (F.col("status") != "enabled"))


def scenario_summaries(entities: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row a scenario: frames, tracks, states, seconds, mean speed and states a second."""
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    own = entities.groupBy("scenario_token").agg(F.count_distinct("track_token").alias("n_tracks"), F.count(F.lit(1)).alias("n_states"), ((F.max("timestamp_us") - F.min("timestamp_us")) / 1e6).alias("seconds"), F.avg(speed).alias("mean_speed"))
    own = own.withColumn("states_per_second", F.when(F.col("seconds") > 0, F.col("n_states") / F.col("seconds")))
    return scenarios.select("scenario_token", "scenario_type", "n_frames").join(own, "scenario_token", "left")


def truth_counts(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """native, measured and semantic facts."""
    kind = F.when(F.col("native"), "native").when(F.col("value_type") == "BOOLEAN", "semantic").otherwise("measurement")
    return tally(facts).join(definitions, "predicate").groupBy(kind.alias("kind")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def unknown_predicates(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Facts whose predicate the catalogue lacks."""
    return facts.join(definitions.select("predicate"), "predicate", "left_anti")


def display_numbers(entities: DataFrame) -> DataFrame:
    """Agents numbered by first appearance in their scenario."""
    first = entities.where(~F.col("is_ego")).groupBy("scenario_token", "track_token").agg(F.min("frame_index").alias("first_frame"), F.min("slot").alias("slot"))
    order = Window.partitionBy("scenario_token").orderBy("first_frame", "slot")
    return first.select("scenario_token", "track_token", "first_frame", F.dense_rank().over(order).alias("display_id"))


def nearest_snapshot(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Of rows (scenario_token, timestamp_us, ...), for each asked (scenario_token, at_us) the nearest in time; the earlier of two as near."""
    at = rows.select("scenario_token", F.col("timestamp_us").alias("t"), F.col("timestamp_us").alias("known"), F.lit(None).cast("bigint").alias("at_us"))
    both = at.unionByName(asked.select("scenario_token", F.col("at_us").alias("t"), F.lit(None).cast("bigint").alias("known"), "at_us"))
    order = Window.partitionBy("scenario_token").orderBy("t")
    before, after = F.max("known").over(order.rangeBetween(Window.unboundedPreceding, 0)), F.min("known").over(order.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("before", before).withColumn("after", after).where("at_us is not null").distinct()
    earlier = F.col("after").isNull() | (F.col("at_us") - F.col("before") <= F.col("after") - F.col("at_us"))
    found = near.select("scenario_token", "at_us", F.when(F.col("before").isNotNull() & earlier, F.col("before")).otherwise(F.col("after")).alias("timestamp_us"))
    return found.where("timestamp_us is not null")


def filter_scenarios(scenarios: DataFrame, types: tuple[str, ...] = (), logs: tuple[str, ...] = (), maps: tuple[str, ...] = (), tokens: tuple[str, ...] = (), per_type: int | None = None, total: int | float | None = None, seed: int | None = None) -> DataFrame:
    """Up to four IN filters, then a seeded order, a cap per type and a total as a number or a share."""
    df = scenarios
    for column, values in (("scenario_type", types), ("log_name", logs), ("map_name", maps), ("scenario_token", tokens)):
        if values:
            df = df.where(F.col(column).isin(*values))
    place = F.xxhash64("scenario_token", F.lit(seed)) if seed is not None else F.col("scenario_token")
    if per_type is not None:
        df = df.withColumn("place", F.row_number().over(Window.partitionBy("scenario_type").orderBy(place))).where(F.col("place") <= per_type).drop("place")
    if total is not None:
        df = df.orderBy(place).limit(int(df.count() * total) if isinstance(total, float) else total)
    return df


def scenarios_by_facts(scenarios: DataFrame, facts: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """scenario_token, n_facts, n_wanted, silent: how much is stated of each scenario, how much of it by the wanted predicates, and whether nothing is."""
    n = facts.groupBy("scenario_token").agg(F.count(F.lit(1)).alias("n_facts"), F.sum(F.col("predicate").isin(*wanted).cast("bigint")).alias("n_wanted"))
    out = scenarios.select("scenario_token").join(n, "scenario_token", "left")
    return out.select("scenario_token", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_facts", "n_wanted")), F.col("n_facts").isNull().alias("silent"))


def entity_kind(node: Column) -> Column:
    """Kind of a node by its prefix."""
    out = F.when(node.startswith("ego:"), "ego")
    for kind, starts in (("agent", ("agent:",)), ("pair", ("pair:",)), ("lane", ("lane:", "lane_connector:")), ("structure", ("roadblock:", "roadblock_connector:", "intersection:", "crosswalk:")), ("scenario", ("scenario:", "observation:"))):
        for s in starts:
            out = out.when(node.startswith(s), kind)
    return out.otherwise("other")


def interesting_agents(pairs: DataFrame, distance: float = 40.0) -> DataFrame:
    """Agents near the ego, ahead in its corridor, or whose clearance at constant velocity falls under 3 m at a sampled time."""
    times = F.array(*(F.lit(x / 2) for x in range(11)))
    dx, dy = F.col("o_x") - F.col("s_x"), F.col("o_y") - F.col("s_y")
    dvx, dvy = F.col("o_vx") - F.col("s_vx"), F.col("o_vy") - F.col("s_vy")
    half = (F.hypot("s_length_m", "s_width_m") + F.hypot("o_length_m", "o_width_m")) / 2
    least = F.array_min(F.transform(times, lambda t: F.sqrt((dx + dvx * t) * (dx + dvx * t) + (dy + dvy * t) * (dy + dvy * t)))) - half
    own = pairs.where("s_is_ego")
    hit = (F.col("center_distance") <= distance) | (F.col("longitudinal").between(0, 70) & (F.abs("lateral") <= 3.5)) | (least <= 3.0)
    return own.where(hit).groupBy("scenario_token", "o_track").agg(F.count(F.lit(1)).alias("n_frames"), F.min("center_distance").alias("least_distance"))


def at_frame(events: DataFrame, frames: DataFrame, frame: str) -> DataFrame:
    """events with timestamp_us of the frame that a column names."""
    return events.join(frames.select("scenario_token", F.col("frame_index").alias(frame), "timestamp_us"), ["scenario_token", frame])


def triples(asserted: DataFrame) -> DataFrame:
    """N-Triples lines of assertions: the fact, and its statement with source and time.

    Names become IRIs with all but letters, digits, ':', '.', '-' and '_' percent-coded;
    numbers, whole numbers and booleans are typed literals; text is escaped.
    """
    plain = lambda c: F.regexp_replace(F.url_encode(c), r"%3A", ":")
    iri = lambda c: F.concat(F.lit("<urn:way:"), plain(F.replace(c, F.lit(" "), F.lit("_"))), F.lit(">"))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([\\\\\"])", r"\\\\$1"), "\n", r"\\\\n"), "\r", r"\\\\r")
    typed = lambda c, kind: F.concat(F.lit('"'), c, F.lit(f'"^^<http://www.w3.org/2001/XMLSchema#{kind}>'))
    literal = (
        F.when(F.col("value_type") == "INTEGER", typed(F.coalesce(F.col("number").cast("bigint").cast("string"), "value"), "integer"))
        .when(F.col("number").isNotNull(), typed(F.col("number").cast("decimal(38,6)").cast("string"), "decimal"))
        .when(F.col("value").isNotNull(), F.concat(F.lit('"'), clean(F.col("value")), F.lit('"')))
        .otherwise(typed(F.lit("true"), "boolean"))
    )
    node, subject, predicate = iri(F.col("assertion_id")), iri(F.col("subject_id")), iri(F.col("predicate"))
    thing = F.when(F.col("object_id").isNotNull(), iri(F.col("object_id"))).when((F.col("value_type") == "ENTITY") & F.col("value").isNotNull(), iri(F.col("value"))).otherwise(literal)
    rdf = lambda name: F.lit(f"<http://www.w3.org/1999/02/22-rdf-syntax-ns#{name}>")
    lines = F.array(
        F.concat_ws(" ", subject, predicate, thing, F.lit(".")),
        F.concat_ws(" ", node, rdf("subject"), subject, F.lit(".")),
        F.concat_ws(" ", node, rdf("predicate"), predicate, F.lit(".")),
        F.concat_ws(" ", node, rdf("object"), thing, F.lit(".")),
        F.concat_ws(" ", node, F.lit("<http://www.w3.org/ns/prov#wasDerivedFrom>"), iri(F.col("scenario_token")), F.lit(".")),
        F.concat_ws(" ", node, F.lit("<http://www.w3.org/ns/prov#atTime>"), typed(F.col("timestamp_us").cast("string"), "integer"), F.lit(".")),
    )
    return asserted.select(F.explode(lines).alias("value"))
