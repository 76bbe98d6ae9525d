from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.sources import tables

OPTION = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _sizes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])


def test_batches_are_small_while_a_table_is_written(spark):
    before = spark.conf.get(OPTION)
    found = tables.written(spark.range(0, 5000, 1, 1).mapInArrow(_sizes, "n long"), "sizes")
    assert spark.conf.get(OPTION) == before and sorted(r.n for r in found.collect()) == [1000] * 5
    with pytest.raises(Exception, match="lost"):
        tables.written(spark.range(3).select(F.raise_error(F.lit("lost")).alias("x")), "bad")
    assert spark.conf.get(OPTION) == before
    tables.dropped(found)
    with pytest.raises(Exception, match="(?i)exist"):
        found.count()
