from __future__ import annotations

import random
import re

import pytest

from siltstone.operators import markup
from siltstone.plans import pages
from tests.oracle import assert_same

ID = {"id_col": "page_id", "text_col": "html"}
SCHEMA = "page_id long, html string, row int, pos int, name string, at int"


@pytest.mark.parametrize("name", sorted(pages.QUERIES))
def test_against_sql(spark, name):
    assert_same(spark, pages.QUERIES[name], pages.ORACLES[name])


def brute(text):
    """(kind, text) of each region, and tags (name, at, opens), by one pass from the left."""
    out, tags, i = [], [], 0

    def upto(mark, start):
        j = text.find(mark, start)
        return len(text) if j < 0 else j + len(mark)

    def tag():
        nonlocal i
        j = upto(">", i)
        name = re.match("</?([A-Za-z][A-Za-z0-9:-]*)", text[i:])
        if name and name[1].lower() not in markup.VOID and not ("<" not in text[i + 1 : j] and text[i:j].endswith("/>")):
            tags.append((name[1].lower(), i, text[i + 1] != "/"))
        out.append(("tag", text[i:j]))
        i = j
        return name[1].lower() if name and text[j - 1] == ">" else ""

    while i < len(text):
        if text.startswith("<!--", i):
            j = upto("-->", i + 4)
            out.append(("comment", text[i:j]))
            i = j
        elif re.match("<[A-Za-z/!?]", text[i:]):
            raw = re.match("(?i)<(script|style)([^A-Za-z0-9]|$)", text[i:])
            tag()
            if raw and out[-1][1].endswith(">"):
                end = re.compile(f"(?i)</{raw[1]}([^A-Za-z0-9]|$)").search(text, i)
                j = end.start() if end else len(text)
                out.append((raw[1].lower(), text[i:j]))
                i = j
                if i < len(text):
                    tag()
        else:
            j = i + 1
            while j < len(text) and not text.startswith("<!--", j) and not re.match("<[A-Za-z/!?]", text[j:]):
                j += 1
            out.append(("text", text[i:j]))
            i = j
    return out, tags


def paired(tags):
    """Tags that close each other, by a stack for each name."""
    held, pairs = {}, {}
    for k, (name, _, opens) in enumerate(tags):
        if opens:
            held.setdefault(name, []).append(k)
        elif held.get(name):
            pairs[held[name].pop()] = k
    return pairs


def texts(seed):
    r = random.Random(seed)
    parts = ["<!--", "-->", "<script", "</script", "<style>", "</style>", ">", "<p>", "</p>", "<b>", "</b>", "<br>", "<i/>", "<", " x < y ", "--", "é🙂", "\n", "<SCRIPT>", "</Script >", "<scripts>", "</styles>", "<!-->", "<1>", "<?php", "<!DOCTYPE html>", "</", "<a href='<q>'>", "a"]
    return [(i if i % 8 else None, "".join(r.choice(parts) for _ in range(r.randrange(0, 40)))) for i in range(120)] + [(3, "<p>same id</p>"), (200, None), (201, "<p>" * 50 + "</p>" * 70 + "<b><p></b></p>")]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_regions_and_blocks_against_one_pass(spark, block):
    rows = texts(block)
    df = spark.createDataFrame([(i, t, 0, 0, "", 0) for i, t in rows], SCHEMA)
    want, wide, nested = [], [], []
    for i, t in rows:
        found, tags = brute(t or "")
        sums = {}
        for kind, said in found:
            n, c = sums.get(kind, (0, 0))
            sums[kind] = n + 1, c + len(said)
        want += [(i, kind, n, c) for kind, (n, c) in sums.items()]
        pairs = paired(tags)
        inside = lambda k: sum(a <= k < b for a, b in pairs.items())
        wide += [(i, tags[a][0], tags[a][1], tags[b][1], inside(a)) for a, b in pairs.items()]
        opened = sum(x[2] for x in tags)
        nested.append((i, max((inside(a) for a in pairs), default=0), opened, opened - len(pairs), len(tags) - opened - len(pairs)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    same = lambda got, want: sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert same(markup.regions(df, block=block, **ID), want)
    assert same(markup.blocks(df, block=block, **ID), wide)
    assert same(markup.nesting(df, block=block, **ID), nested)


def test_one_large_text_and_none(spark):
    text = "<div>" * 3000 + "<!-- <b> -->" * 3000 + "</div>" * 2000
    df = spark.createDataFrame([(1, text, 0, 0, "", 0)], SCHEMA)
    assert sorted(tuple(r) for r in markup.regions(df, block=64, **ID).collect()) == [(1, "comment", 3000, 36000), (1, "tag", 5000, 27000)]
    assert tuple(markup.nesting(df, block=64, **ID).first()) == (1, 2000, 3000, 1000, 0)
    for f in (markup.regions, markup.blocks, markup.nesting):
        assert f(df.limit(0), **ID).count() == 0


def test_other_marks(spark):
    df = spark.createDataFrame([(1, "<%-- a < b --%>x<pre><b></pre><b>")], "page_id long, html string")
    got = markup.regions(df, raw=("pre",), comment=("<%--", "--%>"), **ID).collect()
    assert sorted(tuple(r) for r in got) == [(1, "comment", 1, 15), (1, "pre", 1, 3), (1, "tag", 3, 14), (1, "text", 1, 1)]
    with pytest.raises(ValueError, match="six"):
        markup.pieces_of(df, raw=tuple("abcdefg"), **ID)
