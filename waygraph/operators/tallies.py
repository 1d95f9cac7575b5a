"""Counting facts without stating them: what a family states of a row becomes counts over the table that it reads, one pass for all families of the table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.plans.shared import compiled, cut

#: Predicate: how many facts of it a table's rows state.
Counts = dict[str, Column]


def numbers(df: DataFrame, keys: tuple[str, ...], values: dict[str, Column]) -> tuple[DataFrame, Counts]:
    """In place of unpivot and unpivot_text: the table, and the counts of what they would state."""
    return df, {p: F.count(c) for p, c in values.items()}


def labels(df: DataFrame, keys: tuple[str, ...], columns: list[Column]) -> tuple[DataFrame, list[Column]]:
    """In place of states: the table, and the labels that its rows state."""
    return df, columns


def tallied(df: DataFrame, families: Iterable[Counts | list[Column]]) -> DataFrame:
    """predicate, n of what families count or label of df, worked out once; predicates that nothing states have no row.

    Rows are grouped by all labels, which are few, so that none is compared with each name.
    """
    families = list(families)
    each = [(p, n) for part in families if isinstance(part, dict) for p, n in part.items()]
    named = [c for part in families if isinstance(part, list) for c in part]
    with compiled(df.sparkSession):
        rows = cut(df.groupBy(*(c.alias(f"label{i}") for i, c in enumerate(named))).agg(F.count(F.lit(1)).alias("rows"), *(n.alias(f"n{i}") for i, (_, n) in enumerate(each))))
    both = F.array(
        *(F.struct(F.lit(p).alias("predicate"), F.col(f"n{i}").cast("bigint").alias("n")) for i, (p, _) in enumerate(each)),
        *(F.struct(F.col(f"label{i}").alias("predicate"), F.col("rows").alias("n")) for i in range(len(named))),
    )
    return rows.select(F.inline(both)).where("predicate is not null").groupBy("predicate").agg(F.sum("n").alias("n")).where("n > 0")
