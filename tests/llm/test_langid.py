from __future__ import annotations

import itertools

import numpy as np

from siltstone.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int"


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    scores, moves = r.normal(size=(9, 3)), r.normal(size=(3, 3))
    first = np.array([0, 4, 4, 5, 9])
    got, expected = langid.marginals(scores, moves, first)
    want, pairs = np.zeros_like(scores), np.zeros_like(moves)
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = list(itertools.product(range(3), repeat=b - a))
        w = np.array([np.exp(sum(scores[a + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in itertools.pairwise(p))) for p in paths])
        for p, q in zip(paths, w / w.sum(), strict=True):
            for i, y in enumerate(p):
                want[a + i, y] += q
            for x, y in itertools.pairwise(p):
                pairs[x, y] += q
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_held_out_and_switching(spark):
    r = np.random.default_rng(5)
    parts = {"aa": ["the", "sh", "ing", "wh"], "bb": ["eau", "ou", "qué", "la"], "cc": ["sch", "ein", "ü", "der"]}
    say = lambda k, n: " ".join("".join(r.choice(parts[k], 2)) for _ in range(n))
    rows = [(i, say(k := ["aa", "bb", "cc"][i % 3], 20 + i), k, 0) for i in range(120)]
    model = langid.fit(spark.createDataFrame(rows[:90], SCHEMA))
    more = [(900, None, None, 0), (901, "", None, 0), (902, "12 34 !", None, 0), (903, say("aa", 30) + " " + say("cc", 20), None, 0), (904, "é", None, 0)]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows[90:] + more, SCHEMA), model).collect()}
    assert all(got[d].lang_pred == k and 0 <= got[d].score <= 1 for d, _, k, _ in rows[90:])
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred == "aa" and got[903].n_switches == 1 and 0.5 < got[903].score < 0.7
    assert [tuple(r) for r in got[903].runs] == [("aa", 30), ("cc", 20)] and got[900].runs == []
    assert langid.identify(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert langid.fit(spark.createDataFrame([], SCHEMA)) is None
    assert langid.identify(spark.createDataFrame(rows, SCHEMA), None).where("lang_pred = 'und'").count() == 120


def test_long_tied_and_repeated(spark):
    rows = [(i, "the sh ing " * 40 if i % 2 else "eau ou la " * 40, "aa" if i % 2 else "bb", 0) for i in range(40)]
    rows += [(1, rows[1][1], "aa", 0)] * 30 + [(77, "x" * 50_000 + " the sh", "aa", 0), (78, "é " * 60_000, "bb", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs, rows=44)
    assert model.labels == ["aa", "bb"]
    got = [tuple(r)[:4] for r in langid.identify(docs, model).collect()]
    assert len(got) == len(rows) and len({g for g in got if g[0] == 1}) == 1
    assert {g[1] for g in got if g[0] == 78} == {"bb"}
    assert langid.fit(docs.where("lang is null")) is None


def test_whole_texts_are_learned_from(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 100)
    text = " ".join(f"w{i}" for i in range(1000)).encode()
    assert b"".join(langid._cut(text)) == text and all(len(p) <= 100 for p in langid._cut(text))
    assert b"".join(langid._cut(b"x" * 950)) == b"x" * 950
    parts = langid._parts([text, b"", b"a b"], [0, 1, 1])
    assert sum(len(p.local) for p in parts) == 1002 and sum(int(p.truth.sum()) for p in parts) == 2


def test_gradient_against_differences():
    texts, truth = [b"ab cd ab", b"ef gh", b"ab gh cd ef"], [0, 1, 0]
    parts = langid._parts(texts, truth)
    model, squares = langid._empty(["x", "y"])
    r = np.random.default_rng(3)
    model.moves[:] = r.normal(size=(2, 2))

    def loss(moves):
        total = 0.0
        for p in parts:
            s = langid._emissions(model.weights, p.flat, p.bounds)[p.local].astype(float)
            score = lambda y: sum(s[i, k] for i, k in enumerate(y)) + sum(moves[a, b] for a, b in itertools.pairwise(y))
            total += np.log(sum(np.exp(score(y)) for y in itertools.product(range(2), repeat=len(p.local)))) - score(p.truth)
        return total / sum(len(p.local) for p in parts)

    before = model.moves.copy()
    want = np.array([[(loss(before + d) - loss(before - d)) / 2e-5 for d in (1e-5 * (np.arange(4).reshape(2, 2) == 2 * i + j) for j in range(2))] for i in range(2)])
    assert langid._descend(parts, model, squares, epochs=1, rate=1.0, decay=0.0) == 9
    got = (before - model.moves) * np.sqrt(squares[1])
    assert np.allclose(got, want, atol=1e-5) and model.weights.any()


def test_quotas_and_choice(spark):
    assert langid.quotas({"a": 100, "b": 2, "c": 5}, 30) == {"a": 23, "b": 2, "c": 5}
    assert langid.quotas({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0} and langid.quotas({}, 5) == {}
    rows = [(i, f"word{i} text", "abc"[i % 3]) for i in range(600)] + [(1, "word1 text", "b")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for parts in (1, 7):
        got = langid.training_set(df.repartition(parts), rows=60).collect()
        if parts == 1:
            want = sorted((x.h, x.l) for x in got)
        assert sorted((x.h, x.l) for x in got) == want and len(set(want)) == 60
    assert all(sum(x.l == k for x in got) == 20 for k in "abc")
