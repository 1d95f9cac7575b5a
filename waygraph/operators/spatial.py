"""Sectors, contact and heading states of pairs, and why a sector was left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.config import T, Thresholds
from waygraph.functions.classifiers import contact, heading_state, is_dynamic, sector
from waygraph.operators.entities import states
from waygraph.operators.pairs import PAIR


def with_spatial(pairs: DataFrame, t: Thresholds = T) -> DataFrame:
    """sector (geometry alone), contact_state, heading_state."""
    df = pairs.withColumn("sector", sector(F.col("longitudinal"), F.col("lateral"), F.col("overlapping"), t))
    df = df.withColumn("contact_state", contact(F.col("free_space"), F.col("overlap_area"), F.col("touching"), t))
    return df.withColumn("heading_state", heading_state(F.col("travel_difference"), t)) if "travel_difference" in df.columns else df


def spatial_facts(scored: DataFrame, state: Callable = states) -> DataFrame:
    """Sectors of road users that move, where the relevance decision allows directions; contact and heading states of all pairs."""
    both = is_dynamic(F.col("s_agent_type")) & is_dynamic(F.col("o_agent_type"))
    return state(scored, PAIR, [F.when(both & F.col("directional"), F.col("sector")), F.col("contact_state"), F.col("heading_state")])


def sector_omissions(scored: DataFrame) -> DataFrame:
    """reason and n: pairs without a sector fact, by the first gate that they fail."""
    both = is_dynamic(F.col("s_agent_type")) & is_dynamic(F.col("o_agent_type"))
    why = F.when(~both, "non_dynamic_road_user").when(~F.col("directional"), F.col("direction_omission")).when(F.col("sector").isNull(), "body_frame_inside_deadband_or_overlap")
    return scored.select(why.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
