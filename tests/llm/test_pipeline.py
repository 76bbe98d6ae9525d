from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from siltstone.llm import oracles
from tests.llm.test_minhash import shingles
from tests.llm.test_quality import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(seed):
    """Documents with null and repeated ids: clean, poor, equal, near and empty ones."""
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        words = say(r.choice([20, 40, 60]))
        texts += [" ".join(words)] * r.choice([1, 1, 3]) + [" ".join(words[:-1] + say(1))] * r.choice([0, 1])
    texts += ["a b", "few words", "x y z p q " * 9, "", None, " ".join(say(300))]
    return [(r.choice([None, 1, 2, 3, 4, *range(10, 60)]), t, "en", r.choice(["web", "book", None]), len(t or "")) for t in texts + texts[:4]]


def after(spark, stage, rows, sf_dir=""):
    out = stage(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert out.columns == corpus_pipeline.COLUMNS
    return Counter(tuple(x) for x in out.collect())


def firsts(rows, groups):
    """(id, text) of the row that stays of each group: the least id, null last."""
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return Counter(rows[min(g, key=order)][:1] for g in groups)


def test_rules_judge_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = table(1) + [(7, "a b", "en", "web", 3), (7, " ".join(f"v{i}" for i in range(30)), "en", "web", 9), (None, "c d", "en", "web", 3)]

    def poor(text):
        n, _, _, _, covered = brute(text)
        return n < 10 or 100 * covered > 20 * n

    assert after(spark, corpus_pipeline.rules, rows, str(tmp_path)) == Counter(x for x in rows if not poor(x[1]))


@pytest.mark.parametrize("sent", [corpus_pipeline.SENT, 0])
def test_exact_leaves_one_of_each(spark, monkeypatch, sent):
    monkeypatch.setattr(corpus_pipeline, "SENT", sent)
    rows = table(2) + [(8, "same text", "en", "web", 9), (None, "same  text", "en", "web", 10), (9, "same text", "en", "web", 9), (9, "other", "en", "web", 5)]
    rows += [(None, "no ids", "en", "web", 6)] * 3 + [(70, "one id", "en", "web", 6)] * 4
    groups = {}
    for i, x in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", x[1] or ""), []).append(i)
    got = after(spark, corpus_pipeline.exact, rows)
    assert set(got) <= set(rows) and Counter(x[:1] for x in got.elements()) == firsts(rows, groups.values())
    assert Counter(re.sub(r"[\x20\x09-\x0D]+", " ", x[1] or "") for x in got.elements()) == Counter(groups.keys())


def test_near_leaves_one_of_each(spark):
    rows = table(3) + [(None, " ".join(f"n{i}" for i in range(30)), "en", "web", 6)] * 3 + [(70, " ".join(f"m{i}" for i in range(30)), "en", "web", 6)] * 4
    sets = [shingles(x[1], 5) for x in rows]
    root = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                root = [root[j] if k == root[i] else k for k in root]
    groups = {}
    for i, k in enumerate(root):
        groups.setdefault(k, []).append(i)
    got = after(spark, corpus_pipeline.near, rows)
    assert set(got) <= set(rows) and sum(got.values()) == len(groups) < len(rows)
    assert Counter(x[:1] for x in got.elements()) == firsts(rows, groups.values())


@pytest.mark.parametrize("stage", [corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mix])
def test_stages_run_side_by_side(spark, stage):
    some, more = table(5), table(6)
    alone = [after(spark, stage, x) for x in (some, more)]
    a = stage(spark, spark.createDataFrame(some, SCHEMA), "")
    b = stage(spark, spark.createDataFrame(more, SCHEMA), "")
    corpus_pipeline.mix(spark, b, "")
    ids = lambda df: Counter(x.doc_id for x in df.collect())
    assert [ids(a), ids(b)] == [Counter(x[0] for x in w.elements()) for w in alone]


def test_run(spark, tmp_path):
    rows = [(*x[:4], 0) for x in table(7)] + [(100 + i, " ".join(f"d{i}_{k}" for k in range(40 + i)), "en", "web", 0) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, work in corpus_pipeline.STAGES[:-1]:
        docs = work(spark, docs, str(tmp_path))
    kept = Counter(x.doc_id for x in docs.collect())
    assert Counter(p.doc_id for p in pieces if p.start == 0) == kept and len(kept) > 20
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id, p.doc_tokens] += p.length
    assert all(n % size == 0 for (_, size), n in tokens.items())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((p.doc_id, p.doc_tokens) for p in again if p.start == 0) == Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0)


@pytest.mark.parametrize("sent", [corpus_pipeline.SENT, 0])
def test_mix_takes_rows(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(corpus_pipeline, "SENT", sent)
    rows = table(4) + [(None, "same id and text", "en", "web", 4)] * 6 + [(5, "five words of a document", "en", None, 4)] * 3
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter()
    for doc, size, _, _, taken in con.execute(oracles.ORACLES["op7_fair_mixing"]).fetchall():
        want[doc, size] += taken // size if size else 0
    got = Counter()
    for x, n in after(spark, corpus_pipeline.mix, rows).items():
        got[x[0], len((x[1] or "").split())] += n
        assert n <= 3 * rows.count(x)
    assert after(spark, corpus_pipeline.mix, []) == Counter()
    assert +want == got and any(k[0] is None for k in got)
