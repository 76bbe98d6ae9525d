from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import class_lm

SCHEMA = "doc_id long, text string, score int"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_base_and_gain(spark):
    r = random.Random(1)
    groups = [[f"{p}{i}" for i in range(30)] for p in "abc"]
    rows = [(i, " ".join(r.choice(groups[k % 3]).upper() for k in range(i % 3, i % 3 + 60)), 0) for i in range(200)]
    rows += [(500, None, 0), (501, "", 0), (502, "É new\x0bWords", 0)]
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = {x.doc_id: x for x in class_lm.score_texts(spark.createDataFrame(rows, SCHEMA), train, classes=8, rounds=3).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
    c = Counter(w for d, t, _ in rows if not held[d] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for d, t, _ in rows:
        w, x = tokens(t), got[d]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[d], len(w), sum(c[y] > 0 for y in w), n)
        assert math.isclose(x.base_score, sum(math.log10((c[y] + 1) / (n + v + 1)) for y in w), rel_tol=1e-9)
    out = [x for x in got.values() if x.held_out and x.n_tokens > 9]
    assert sum(x.score for x in out) > sum(x.base_score for x in out) + 10 * len(out)


def test_empty(spark):
    assert class_lm.score_texts(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_exchange_raises_the_objective():
    r = np.random.default_rng(3)
    kind = r.integers(0, 3, 60)
    text = []
    for i in range(6000):
        text.append(int(r.choice(np.flatnonzero(kind == i % 3))))
    words, classes = np.array(text), 4
    now = r.integers(0, 3, 60)

    def counts(now):
        cls = np.append(now[words], classes)
        before = np.append(classes, cls[:-1])
        m = np.zeros((classes + 1, classes + 1))
        np.add.at(m, (before, cls), 1)
        left, right = np.zeros((60, classes + 1)), np.zeros((60, classes + 1))
        np.add.at(left, (words, before[:-1]), 1)
        np.add.at(right, (words, cls[1:]), 1)
        return m, left, right

    n, seen = np.bincount(words, minlength=60), []
    for steps in (10**6, 10**6, 10, 10):
        m, left, right = counts(now)
        seen.append(class_lm.objective(m))
        now = class_lm.exchange(m, left, right, n, now, steps)
    seen.append(class_lm.objective(counts(now)[0]))
    assert seen[1] > seen[0] and seen[2] >= seen[1] - 1e-6 and seen[-1] >= seen[1] - 1e-6
    assert len({(k, c) for k, c in zip(kind, now, strict=True)}) == len(set(now))  # no class mixes kinds


def test_repeats_nulls_and_long_texts(spark):
    rows = [(1, "a b", 0)] * 3 + [(None, "a c", 0), (2, "w " * 40_000, 0), (2, None, 0)]
    train = F.when(F.col("doc_id") == 1, True).when(F.col("text").isNull(), False)
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens, x.n_known, x.held_out, x.train_tokens) for x in class_lm.score_texts(spark.createDataFrame(rows, SCHEMA), train, classes=4).collect())
    assert got == [(False, 1, 3, 3, False, 9)] * 3 + [(False, 2, 1, 1, True, 9), (False, 2, 40_001, 1, True, 9), (True, 0, 3, 2, True, 9)]
