from __future__ import annotations

import hashlib
import random
import re

import pytest

from siltstone.llm import winnowing

SCHEMA = "doc_id long, text string, row int, at int, n_words int, item string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    found = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, said in items:
            q = words(said)
            m = min(window, len(q))
            for s in range(len(q) - m + 1) if m else ():
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == q[s : s + m]:
                        hit |= set(range(i, i + m))
                        names.add("" if item is None else str(item))
        spans = sum(i - 1 not in hit for i in hit)
        found.append((doc, len(w), len(hit), spans, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return found


def key(r):
    return r[0] is None, r[0] or 0, *r[1:]


def tables(seed, vocabulary):
    r = random.Random(seed)
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i if i % 7 else None, say(r.choice([0, 1, 2, 4, 9, 10, 11, 25]))) for i in range(25)] + [(3, say(14)), (2, say(12))]
    items.append((90, items[5][1][:] + say(12)))
    docs = []
    for i in range(60):
        said = say(r.choice([0, 3, 9, 10, 40, 80]))
        for _ in range(r.choice([0, 0, 1, 2])):
            q = r.choice(items)[1]
            a = r.randrange(0, len(q) + 1)
            said[len(said) // 2 : len(said) // 2] = q[a : a + r.choice([4, 9, 10, 15, 30])]
        docs.append((i if i % 9 else None, " ".join(said)))
    text = lambda q: r.choice([" ", ", ", "\n-- "]).join(x.upper() if r.random() < 0.2 else x for x in q)
    return docs + docs[:5] + [(4, None), (70, ""), (71, "!!! ... "), (72, "é " * 12 + " ".join(items[-1][1]))], [(i, text(q) if q else None) for i, q in items]


@pytest.mark.parametrize(("window", "gram"), [(10, 5), (10, 10), (6, 1), (3, 2)])
@pytest.mark.parametrize("sent", [winnowing.SENT, 0])
@pytest.mark.parametrize("vocabulary", [["a", "b"], [f"v{i}é" for i in range(3000)]])
def test_against_brute_force(spark, window, gram, sent, vocabulary):
    docs, items = tables(window, vocabulary)
    left = spark.createDataFrame([(d, t, 0, 0, 0, "") for d, t in docs], SCHEMA)
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, size int")
    got = winnowing.decontaminate(left, right, window=window, gram=gram, sent=sent).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items, window), key=key)


def test_long_and_empty(spark):
    passage = " ".join(f"q{i}" for i in range(40))
    docs = [(1, "w " * 200_000 + passage + " w" * 10), (2, passage[:100]), (3, "W" * 100_000), (4, None)]
    left = spark.createDataFrame([(d, t, 0, 0, 0, "") for d, t in docs], SCHEMA)
    right = spark.createDataFrame([(1, passage), (2, "another item of more than ten words that is in no text at all")], "item_id long, text string")
    got = sorted(winnowing.decontaminate(left, right).collect())
    assert [(x.doc_id, x.n_words, x.n_hit, x.n_spans, x.n_items, x.contaminated) for x in got[:1]] == [(1, 200_050, 40, 1, 1, True)]
    assert sorted(map(tuple, got)) == sorted(brute(docs, [(1, passage)], 10))
    assert winnowing.decontaminate(left.limit(0), right).count() == 0
    clean = winnowing.decontaminate(left, right.limit(0)).collect()
    assert len(clean) == 4 and not any(x.contaminated or x.n_items for x in clean)
    with pytest.raises(ValueError, match="gram"):
        winnowing.decontaminate(left, right, gram=11)
