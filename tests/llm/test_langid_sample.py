from __future__ import annotations

from siltstone.llm import langid


def test_rare_language_is_learned(spark):
    rows = [(i, "the sh ing wh", "aa") for i in range(400)] + [(900, "eau ou la", "bb"), (901, "sch ein der", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, rows=6).labels == ["aa", "bb", "cc"]
