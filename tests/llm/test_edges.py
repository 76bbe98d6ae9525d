"""Nulls, repeats, ties, empty tables, string ids and clashing columns."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import exact_dedup, graph, mixing, quality

SCHEMA = "doc_id long, text string, source string, key int, size int, rows int, least int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, 0, 0, 0, 0) for d, t, s in rows], SCHEMA)


def test_exact_dedup(spark):
    long = "word " * 60_000
    rows = [(3, "a  b", "x"), (1, "a\tb", "x"), (1, "a b", "x"), (None, "a b", "x"), (7, None, "x"), (6, "", "x"), (9, long, "x"), (8, long + " ", "x"), (10, long + "x", "x"), (None, "alone", "x"), (11, " a b", "x")]
    got = sorted((x.doc_id is None, x.doc_id or 0, x.keep_id is None, x.keep_id or 0, x.group_size, x.kept) for x in exact_dedup.exact_dedup(table(spark, rows)).collect())
    assert got == sorted([(False, 3, False, 1, 4, False), (False, 1, False, 1, 4, True), (False, 1, False, 1, 4, True), (True, 0, False, 1, 4, False), (False, 7, False, 6, 2, False), (False, 6, False, 6, 2, True), (False, 9, False, 8, 2, False), (False, 8, False, 8, 2, True), (False, 10, False, 10, 1, True), (True, 0, True, 0, 1, True), (False, 11, False, 11, 1, True)])
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_fair_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "SPAN", 4)
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randrange(1, 40)), "abcd"[i % 4] if i % 9 else None) for i in range(300)]
    rows += [(7, rows[7][1], rows[7][2])] * 20 + [(None, "x y z", "a")] * 10 + [(400, None, "a"), (401, "", "b")]
    got = mixing.fair_mix(table(spark, rows)).collect()
    assert Counter(x.doc_id for x in got) == Counter(d for d, *_ in rows)
    sizes, taken = Counter(), Counter()
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        assert x.taken in (0, x.size, 2 * x.size, 3 * x.size)
    target = {x.source: x.target for x in got}
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 and all(target[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 120 for s in sizes)
    again = mixing.fair_mix(table(spark, rows).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.fair_mix(table(spark, [])).count() == 0


def test_fair_mix_takes_string_ids(spark):
    docs = spark.createDataFrame([(f"d{i}" if i % 5 else None, "a b c " * (i % 4), "ab"[i % 2]) for i in range(60)], "doc_id string, text string, source string")
    got = mixing.fair_mix(docs).collect()
    assert len(got) == 60 and sum(x.taken for x in got) > 0


def test_rules_are_learned_and_ordered(spark):
    r = np.random.default_rng(1)
    n = 900
    x = {k: r.random(n) for k in quality.FEATURES}
    poor = (x["upper_per_char"] > 0.8) | ((x["marks_per_word"] < 0.2) & (x["repeat_share"] > 0.5))
    rules = quality.learn_rules(x, poor)
    caught = np.any([rule.matches(x) for rule in rules], axis=0)
    assert caught[poor].mean() > 0.9 and caught[~poor].mean() < 0.03
    assert quality.learn_rules(x, np.zeros(n, bool)) == [] and quality.learn_rules({k: v[:0] for k, v in x.items()}, poor[:0]) == []
    first = quality.Rule((("symbols_per_word", True, 0.5),)), quality.Rule((("symbols_per_word", True, 0.1),))
    stats = quality.statistics(spark.createDataFrame([(1, "# " * 20), (2, "a b c d # f g h"), (3, "a b"), (None, None)], "doc_id long, text string"))
    assert {(y.doc_id, y.rule) for y in stats.withColumn("rule", quality.decision(list(first))).collect()} == {(1, 1), (2, 2), (3, 0), (None, 0)}


def test_rules_with_null_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, ("# " if i % 3 == 0 else "word ") * (12 + i % 7)) for i in range(240)] + [(None, "x"), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] * 2 + [(None, 0), (3, None), (500, 1), (9999, 0)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    judged = quality.apply_rules(quality.statistics(docs), rules).where("doc_id < 240").collect()
    assert rules and all((y.rule > 0) == (y.doc_id % 3 == 0) for y in judged)
    assert quality.fit(docs, labels.limit(0)) == [] and quality.fit(docs.limit(0), labels) == []
    assert quality.apply_rules(quality.statistics(docs.limit(0)), rules).count() == 0


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(5, 5), (1, 2), (2, 1), (1, 2)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            up[root(a)] = root(b)
    got = {x.id: x.root for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == set(up)
    pairs = {(got[x], root(x)) for x in up}
    assert len(pairs) == len(set(got.values())) == len({root(x) for x in up})
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
