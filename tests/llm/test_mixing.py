from __future__ import annotations

from siltstone.llm import mixing, oracles, queries
from tests.oracle import assert_same

SCHEMA = "doc_id long, text string, source string"


def test_document_longer_than_twice_its_target(spark, tmp_path):
    rows = [(i, "a b c d e f g h i j", "a") for i in range(100)] + [(900, "w " * 3500, "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in mixing.fair_mix(docs).collect()}
    assert (got[0].target, got[900].target) == (3000, 1500)
    assert got[900].taken == 0 and sum(x.taken for x in got.values()) == 3000
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = oracles.ORACLES["op7_fair_mixing"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(spark, lambda s, _: queries.QUERIES["op7_fair_mixing"](s, str(tmp_path)), sql)
