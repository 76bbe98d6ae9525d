from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import lossy
from siltstone.operators.carry import carried
from siltstone.plans import queries as tables
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_last_values(spark, block):
    r = random.Random(block)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(-20, 60)]), r.choice(["x", "y", None]), r.choice([None, None, 1, 2, 3]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, turn long, word string, v int, id int")
    got = carried(df, keys=["k"], block=F.floor(F.col("turn") / block), order=[F.col("turn"), F.col("id")], columns={"last_v": F.col("v"), "last_word": F.col("word")})
    assert got.columns == ["k", "turn", "word", "v", "id", "last_v", "last_word"]
    want, last = {}, {}
    for k, turn, word, v, i in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[4])):
        want[i] = last.get((k, "v")), last.get((k, "w"))
        last |= ({(k, "v"): v} if v is not None else {}) | ({(k, "w"): word} if word is not None else {})
    assert {x.id: (x.last_v, x.last_word) for x in got.collect()} == want
    assert carried(df.limit(0), keys=["k"], block=F.lit(0), order=[F.col("turn")], columns={"z": F.col("v")}).count() == 0


@pytest.mark.parametrize("block", [1, 2])
def test_conversations_in_many_blocks(spark, block):
    assert_same(spark, lambda s, d: tables.turn_context(s, d, block=block), tables.ORACLES["turn_context"], SF)


def test_cut_bytes(spark):
    texts = ["", "abc", "é" * 10, "漢" * 10, "🙂" * 5, "a🙂é漢b" * 3, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(1, 13):
        got = df.select("t", lossy.first_bytes(F.col("t"), n).alias("a"), lossy.last_bytes(F.col("t"), n).alias("b")).collect()
        for x in got:
            if x.t is None:
                assert x.a is None and x.b is None
                continue
            raw = x.t.encode()
            assert x.a == raw[:n].decode("utf-8", "replace") and x.b == raw[max(0, len(raw) - n) :].decode("utf-8", "replace")
    raw = [b"\xff\xfea", b"\xc3", b"\xf0\x9f\x99", b"\xe2\x28\xa1", b"ok\x80", b"\xed\xa0\x80", b"\xc0\xaf"]
    got = spark.createDataFrame([(x,) for x in raw], "x binary").select("x", lossy.decoded(F.col("x")).alias("t")).collect()
    assert all(r.t == bytes(r.x).decode("utf-8", "replace") for r in got)
