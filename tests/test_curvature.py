"""Curvature of baselines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.operators import mapmatch


@pytest.mark.parametrize("side", [1, -1])
def test_curved_baseline_states_its_curvature(spark, side):
    at = np.linspace(0, 1.5, 61)
    x, y = 20 * np.sin(at), side * 20 * (1 - np.cos(at))
    assert mapmatch.curvature(np.stack([x, y], 1), np.array([0.0, 7.0, 29.0])) == pytest.approx([side / 20] * 3, rel=1e-3)
    assert mapmatch.curvature(np.array([[0.0, 0.0], [5.0, 0.0]]), np.array([1.0])).tolist() == [0.0]
    box = [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)]
    lanes = spark.createDataFrame([("m", "L", "lane", box, list(zip(x.tolist(), y.tolist(), strict=True)))], "map_name string, object_id string, kind string, polygon array<struct<x:double,y:double>>, baseline array<struct<x:double,y:double>>")
    own = spark.createDataFrame([("s", 0, 0, "a", float(x[30]), float(y[30]), 1.0, 0.0, 4.0, 2.0)], "scenario_token string, frame_index int, timestamp_us long, track_token string, x double, y double, cos_h double, sin_h double, length_m double, width_m double")
    chosen = mapmatch.primary(mapmatch.candidates(own, spark.createDataFrame([("s", "m")], "scenario_token string, map_name string"), lanes))
    wide = chosen.withColumns({"speed_limit_mps": F.lit(None).cast("double"), "route_rank": F.lit(None).cast("int"), "travel_heading": F.lit(None).cast("double")})
    stated = [r.value for r in mapmatch.map_facts(wide).where("predicate = 'hasBaselineCurvature'").collect()]
    assert stated == [pytest.approx(side / 20, rel=1e-3)]
