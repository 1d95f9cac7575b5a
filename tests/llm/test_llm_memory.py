"""Python workers stay small: what a batch or a block has freed goes back to the system."""

import pytest
from pyspark.sql import functions as F

from waygraph.llm import common


@pytest.fixture
def one_row_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("added", [False, True])
def test_a_batch_gives_back_what_it_has_freed(spark, one_row_batches, added):
    kept: list = []

    def kernel(cols):
        import re

        import numpy as np

        with open("/proc/self/smaps_rollup") as f:
            now = int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) >> 10
        # 128 MB on the C library's heap, too small each for mappings of their own; the last one stays and lies above the others
        kept.append([np.ones(8_000) for _ in range(2_000)][-1])
        return {"mb": [now] * len(cols["id"])}

    rows = spark.range(3, numPartitions=1).select(F.col("id"))
    got = common.add_arrow(rows, ["id"], kernel, "mb bigint") if added else common.map_arrow(rows, kernel, "mb bigint")
    first, *later = [r.mb for r in got.collect()]
    assert len(later) == 2 and max(later) < first + 64
