from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import pii

SCHEMA = "doc_id long, text string, base int"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0]))


def test_base_against_brute_force(spark):
    r = random.Random(2)
    bits = ["a@b.c", "@", ".", "_", "%", "x", "1", "255", "256", "+1 (234) 555-1234", " ", "-", "4111 1111-1111 1111", "4111111111111111", "10.0.0.1", "00255.1.1.1", "é", "𝄞", "\ufdd0", "\ufdd3", "\n", "user.name+t@mail-1.example.co", "--", "..", "+", "(", "$0", "\\"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(1, 25))), 0) for i in range(1500)]
    rows += [(5000, None, 0), (5001, "", 0), (5002, "1 " * 20000, 0), (5003, "a" * 100000, 0), (5004, "a@b" + ".c" * 20000, 0)]
    got = pii.find_pii(spark.createDataFrame(rows, SCHEMA), pii.Boosted()).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()
    bad = [(rows[0], x.b) for x in got if x.b != brute(dict((a, b) for a, b, _ in rows)[x.doc_id])]
    assert len(got) == len(rows) and not bad


def test_method_adds_and_redacts(spark):
    r = random.Random(4)
    number = lambda: f"({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
    rows = [(i, f"word here +1 {number()} and in {r.randrange(1900, 2030)} {r.randrange(10)} {r.randrange(10**7, 10**8)} b", 0) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, "call (743) 555-3824 now, 1.2.3.4", 0)], SCHEMA)
    model = pii.fit(docs)
    assert np.isfinite(model.thresholds[3]) and model.held[3][0] >= 5 and model.held[3][1] >= 0.98 * model.held[3][0]
    found = pii.find_pii(docs, model)
    x = found.where("doc_id = 900").select(pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).first()
    assert (x.b, x.s) == ("ip:25:32", "ip:25:32,phone:5:19")
    assert pii.redact(found).where("doc_id = 900").first().text == "call [PHONE] now, [IP]"
    assert found.where("doc_id < 900 and size(spans) <> size(base)").count() < 10
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find_pii(empty, pii.fit(empty)).count() == 0


def test_isotonic():
    r = np.random.default_rng(1)
    for _ in range(20):
        n = int(r.integers(1, 40))
        score, right = r.integers(0, 12, n).astype(float), r.random(n) < 0.5
        got, best = pii.isotonic(score, right), None
        levels = np.unique(score)
        # The least squares fit that rises: max-min of means over ranges of scores.
        mean = lambda i, j, s=score, y=right, v=levels: y[(s >= v[i]) & (s <= v[j])].mean()
        best = [max(min(mean(i, j) for j in range(k, len(levels))) for i in range(k + 1)) for k in range(len(levels))]
        assert np.allclose(got, np.array(best)[np.searchsorted(levels, score)])
    assert len(pii.isotonic(np.zeros(0), np.zeros(0, bool))) == 0


def test_spans_are_chosen_by_score(spark):
    # One tree on the number of digits: ten or more are far above the threshold, fewer below.
    tree = (0, 9.5, (0, 9.5, -3.0, -3.0), (0, 9.5, 3.0, 3.0))
    texts = ["call 555-123-4567 or 555-1234", "555-123-4567", "555-1234", "+1 555 123 4567 x 555-123-4567", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def added(thresholds):
        found = pii.find_pii(docs, pii.Boosted(0.0, (tree,), thresholds)).select("doc_id", "base", "spans").collect()
        return {x.doc_id: [(s.start, s.end) for s in x.spans if s not in x.base] for x in found}

    inf = float("inf")
    assert added((inf, inf, inf, 0.0)) == {0: [(5, 17)], 1: [(0, 12)], 2: [], 3: [(18, 30)], 4: [], 5: []}
    assert added((inf, inf, inf, -9.0))[2] == [(0, 8)] and added((0.0, 0.0, 0.0, inf))[1] == []
    assert added((inf, inf, inf, 5.0)) == dict.fromkeys(range(6), [])


def test_what_is_learned_from_is_bounded(spark):
    rows = [(i, f"no {i} " + "5 " * 300, 0) for i in range(80)] + [(3, "no 3 " + "5 " * 300, 0)] * 50 + [(None, "1 2", 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(x.h for x in pii.training_texts(docs, rows=20).collect())
    assert len(set(want)) == 20 and sorted(x.h for x in pii.training_texts(docs.repartition(5), rows=20).collect()) == want
    seen = []
    real, pii.boost = pii.boost, lambda x, y, k: seen.append(len(x)) or real(x, y, k)
    try:
        pii.fit(docs, rows=20, per_doc=7)
    finally:
        pii.boost = real
    assert 0 < seen[0] <= 140
