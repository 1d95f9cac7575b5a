"""Sources and sinks of canonical tables and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.plans.scene import Scene


def read_scene(spark: SparkSession, root: str) -> Scene:
    """The canonical tables under root, one Parquet folder each."""
    return Scene(*(spark.read.parquet(f"{root}/{name}") for name in Scene.__dataclass_fields__))


def write_scene(scene: Scene, root: str) -> None:
    for name in Scene.__dataclass_fields__:
        getattr(scene, name).write.mode("overwrite").parquet(f"{root}/{name}")


def sample_frames(frames: DataFrame, every: int = 1, most_scenarios: int | None = None, most_frames: int | None = None) -> DataFrame:
    """Each `every`-th frame, of the first scenarios and frames asked for."""
    df = frames.where(F.col("frame_index") % every == 0)
    if most_frames is not None:
        df = df.where(F.col("frame_index") < most_frames)
    if most_scenarios is not None:
        first = df.select("scenario_token").distinct().orderBy("scenario_token").limit(most_scenarios)
        df = df.join(first, "scenario_token", "left_semi")
    return df


def write_facts(facts: DataFrame, path: str, kind: str = "parquet", codec: str = "zstd", rows_per_file: int = 250_000) -> None:
    """parquet by category, in order of scenarios within a task so that readers skip row groups, json lines, csv, or N-Triples text."""
    if kind == "parquet":
        facts = facts.sortWithinPartitions(*(c for c in ("category", "scenario_token") if c in facts.columns))
    out = facts.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    if kind == "parquet":
        (out.partitionBy("category") if "category" in facts.columns else out).option("compression", codec).parquet(path)
    elif kind == "json":
        out.json(path)
    elif kind == "csv":
        out.option("header", True).csv(path)
    elif kind == "ntriples":
        out.text(path)
    else:
        raise ValueError(kind)


def read_facts(spark: SparkSession, path: str, scenario: str | None = None) -> DataFrame:
    """Facts of all parts, with merged schemas and repeated assertions dropped; of one scenario where asked."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    if scenario is not None:
        df = df.where(F.col("scenario_token") == scenario)
    return df.dropDuplicates(["assertion_id"])


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, scenario_token, n: which part files hold which scenarios."""
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_path").alias("file"), "scenario_token").agg(F.count(F.lit(1)).alias("n"))


def write_indexed(facts: DataFrame, path: str, scenarios_per_file: int = 50) -> None:
    """facts ordered by scenario over files, and beside them a table of which file holds which span of scenarios.

    Files come from a range partitioning, so that a scenario lies in one file, whatever
    its size, and a file is written by one task.
    """
    spark = facts.sparkSession
    files = max(1, -(-facts.select("scenario_token").distinct().count() // scenarios_per_file))
    facts.repartitionByRange(files, "scenario_token").sortWithinPartitions("scenario_token", "timestamp_us").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/facts")
    held = spark.read.parquet(f"{path}/facts").groupBy(F.col("_metadata.file_name").alias("file"))
    held.agg(F.min("scenario_token").alias("first"), F.max("scenario_token").alias("last"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/index")


def read_indexed(spark: SparkSession, path: str, first: str, last: str | None = None) -> DataFrame:
    """Facts of a scenario, or of all from first to last, from the files alone whose span meets them; none where no file does."""
    last = first if last is None else last
    spans = spark.read.parquet(f"{path}/index").where((F.col("first") <= last) & (F.col("last") >= first)).select("file")
    # as many names as files hold the scenarios asked for
    files = [f"{path}/facts/{row.file}" for row in spans.orderBy("file").collect()]
    if not files:
        return spark.read.parquet(f"{path}/facts").limit(0)
    return spark.read.parquet(*files).where(F.col("scenario_token").between(first, last))
