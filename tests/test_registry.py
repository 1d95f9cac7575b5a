"""Categories bring their families and stages, and no others; coverage and counts look at all families."""

import pytest
from pyspark.sql import functions as F

from waygraph import catalog, queries
from waygraph.operators import query
from waygraph.plans import registry

SF = "/root/testdata/sf0.001"


def test_registry_names_what_there_is():
    every = queries.FAMILIES | queries.EVENT_FAMILIES
    assert set(registry.FAMILIES) == set(every)
    assert {s for _, stages in registry.FAMILIES.values() for s in stages} <= set(registry.STAGES)
    assert all(hasattr(queries.Stages, s) for s in registry.STAGES)
    order = registry.stages_of(registry.FAMILIES)
    assert all(order.index(below) < order.index(stage) for stage in order for below in registry.STAGES[stage])
    with pytest.raises(ValueError, match="no family states weather"):
        registry.families_of(("motion", "weather"))


def test_a_category_builds_its_own_stages_alone(spark):
    s = queries.Stages(spark, SF)
    got = queries.assertions_of_categories(s, ("motion_state",))
    assert {r.category for r in got.select("category").distinct().collect()} == {"motion_state"}
    built = set(vars(s)) & set(registry.STAGES)
    assert built == {"users", "moving", "history"}


def test_counts_are_of_all_families(spark):
    s = queries.Stages(spark, SF)
    facts = queries.assertions_of(s).select("predicate", "category").cache()
    n = {r.predicate: r["count"] for r in facts.groupBy("predicate").count().collect()}
    # facts of a category come from a family that declares it
    declared = {c for categories, _ in registry.FAMILIES.values() for c in categories}
    assert {r.category for r in facts.select("category").distinct().collect()} <= declared
    assert {"changesLane", "mergesInFrontOf", "overtakes", "yieldsTo", "hasConflictRiskWith", "geometricallyVisibleToEgo"} <= set(n)
    covered = {r.predicate: (r.n, r.covered) for r in query.coverage(facts, catalog.definitions(spark)).collect()}
    assert all(covered[p] == (k, True) for p, k in n.items())
    assert {p for p, (k, ok) in covered.items() if not ok} == {p for p, _, _, _, status in catalog.rows() if status == "enabled"} - set(n)
    assert {r.predicate: r.n for r in query.counts(facts.drop("category"), catalog.definitions(spark)).collect()} == n
    assert query.truth_counts(facts.drop("category"), catalog.definitions(spark)).agg(F.sum("n")).first()[0] == sum(n.values())
    facts.unpersist()
