from __future__ import annotations

import random
import re

from siltstone.llm import minhash

SCHEMA = "doc_id long, text string, n_shingles int"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent=80):
    sets = [(d, shingles(t, k)) for d, t, *_ in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def test_against_all_pairs(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ABC", "x y"]
    rows = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([1, 3, 20, 90, 200]))]
        for _ in range(r.choice([1, 2, 6])):
            base = [r.choice(vocab) if r.random() < 0.02 else w for w in base]
            rows.append((len(rows) + 5, " ".join(base), 0))
    rows += [(900, None, 0), (901, "", 0), (902, " \n", 0), (903, "One", 0), (904, "oNE ", 0), (1, rows[3][1], 0)]
    for k in (2, 5):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=k).collect()}
        assert got == brute(rows, k)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c", 0), (2, "a b c", 0), (2, "a b c", 0), (2, "d e f", 0), (7, "d e f", 0)]
    got = sorted(tuple(x) for x in minhash.near_duplicates(spark.createDataFrame(rows[1:], SCHEMA), shingle=2).collect())
    assert [x[2] for x in got] == [2, 2, 2, 2]
    assert minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).where("doc_id is null and component_id is null and kept").count() == 1
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_shingles_find_all_pairs_and_not_those_of_a_passage(spark):
    r = random.Random(8)
    own = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    passage = own(60)
    # Each is a passage and about a fourth of its own words: similar, but never enough.
    shared = [passage + own(20) for _ in range(30)]
    copies, base = [], own(120)
    for _ in range(25):
        copies.append([own(1)[0] if r.random() < 0.04 else w for w in base])
    texts = [" ".join(t) for t in shared + copies]
    for k in (2, 5):
        table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
        open_ = table.selectExpr("node", "node as root")
        got = {tuple(sorted(p)) for p in minhash._by_rare_shingles(open_, table, k, 80)[0].collect()}
        sets = [shingles(t, k) for t in texts]
        near = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
        assert near and near <= got
        assert not [p for p in got if p[0] < len(shared)]
