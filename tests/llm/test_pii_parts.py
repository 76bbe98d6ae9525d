from __future__ import annotations

import random

from pyspark.sql import functions as F

from siltstone.llm import pii

SCHEMA = "doc_id long, text string, base int"


def test_personal_data_beside_other_numbers(spark):
    r = random.Random(4)
    number = lambda: f"({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
    rows = [(i, f"word here +1 {number()} and in {r.randrange(1900, 2030)} {r.randrange(10)} {r.randrange(10**7, 10**8)} b", 0) for i in range(300)]
    model = pii.fit(spark.createDataFrame(rows, SCHEMA))
    texts = ["call (743) 555-3824 10.0.0.1", "(555) 123-4567 (555) 987-6543", "(743) 555-3824 10.0.0.1 (555) 987-6543"]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts, 900)), "doc_id long, text string"), model).orderBy("doc_id")
    assert [x.s for x in got.select(pii.listed(F.col("spans")).alias("s")).collect()] == ["ip:20:28,phone:5:19", "phone:0:14,phone:15:29", "ip:15:23,phone:0:14,phone:24:38"]


def test_parts_are_proposed(spark):
    texts = ["call 555-123-4567 10.0.0.1", "12 4111 1111 1111 1111", "(555-123-4567) 1 2", "ann [at] x.com. bob@y.org", "7 " * 30 + "555-123-4567", None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: {(texts[x.doc_id][c.start : c.end], c.k, c.known) for c in x.cands} for x in pii.candidates(pii.base_spans(table)).collect()}
    assert ("555-123-4567", 3, False) in got[0] and ("10.0.0.1", 3, True) in got[0]
    assert ("4111 1111 1111 1111", 2, False) in got[1]
    assert ("555-123-4567", 3, False) in got[2]
    assert ("ann [at] x.com", 0, False) in got[3]
    assert ("555-123-4567", 3, False) in got[4] and (texts[4], 3, False) in got[4]
    assert not got[5] and not got[6]
