from __future__ import annotations

import random

from pyspark.sql import functions as F

from siltstone.llm import pii

SCHEMA = "doc_id long, text string"
#: Takes what has at least six digits, longer ones first.
MODEL = pii.Boosted(0.0, ((0, 5.0, (0, 9.0, -1.0, -1.0), (1, 14.0, 1.0, 2.0)),), (0.5,) * 4)


def test_segments_do_not_change_results(spark):
    r = random.Random(9)
    bits = ["a@b.c", "ann [at] x.com", "me @ y . org", "x", "call", "phone: ", "255", "10.0.0.1", "+1 (234) 555-1234", "(555) 123-4567", "4111 1111-1111 1111", " ", " ", ", ", "\n", "+", ".", "-", "(", ")", "[", "]", "/", "@", "%", "_", "é", "𝄞", "﷐"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(1, 40)))) for i in range(600)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, SCHEMA)

    def results(segment):
        found = pii.find_pii(docs, MODEL, segment=segment)
        shown = found.select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect()
        return sorted(map(tuple, shown)), sorted(map(tuple, pii.redact(found).collect()))

    whole = results(10**6)
    assert results(1) == whole
    assert any(s != b for _, b, s in whole[0])


def test_many_matches_in_one_text(spark):
    text = ", ".join("(555) 123-4567" if i % 2 else "+1 555 123 4567" for i in range(20_000))
    found = pii.find_pii(spark.createDataFrame([(1, text)], SCHEMA), MODEL)
    got = found.select(F.size("base").alias("b"), F.size("spans").alias("s")).first()
    assert (got.b, got.s) == (10_000, 20_000)


def test_repeated_rows_and_a_list_without_an_edge(spark):
    numbers = " ".join(f"555123{i:04d}" for i in range(400))
    rows = [(1, numbers), (1, numbers), (None, numbers), (2, "call 555-123-4567"), (2, "call 555-123-4567")]
    docs = spark.createDataFrame(rows, SCHEMA)

    def spans(segment):
        found = pii.find_pii(docs, MODEL, segment=segment).select("doc_id", pii.listed(F.col("spans")).alias("s"))
        return sorted((r.doc_id or 0, r.s) for r in found.collect())

    got = spans(64)
    # The model takes the longest: the whole list, whatever the segments.
    assert got == spans(10**6) == [(0, f"phone:0:{len(numbers)}")] + [(1, f"phone:0:{len(numbers)}")] * 2 + [(2, "phone:5:17")] * 2
