from __future__ import annotations

import random

import numpy as np
import pytest
import regex

from siltstone.operators import duplicates, token_windows


def files(seed, vocabulary):
    r = random.Random(seed)
    say = lambda n: [r.choice(vocabulary) + r.choice([" ", " ", "\n", "\r\n", ", "]) for _ in range(n)]
    shared = [say(30) for _ in range(3)]
    out = []
    for i in range(25):
        said = say(r.randrange(0, 60))
        for _ in range(r.choice([0, 1, 2])):
            s = r.choice(shared)
            a, at = r.randrange(0, 20), r.randrange(0, len(said) + 1)
            said[at:at] = s[a : a + r.randrange(1, 30)]
        out.append((f"f{i}", "".join(said)))
    return [*out, ("null", None), ("empty", ""), ("copy", out[0][1]), ("twice", "".join(shared[0] * 2)), ("long", "".join(say(40)) * 30)]


@pytest.mark.parametrize(("size", "least"), [(10, 3), (7, 1), (1, 1), (2, 2), (100, 6)])
@pytest.mark.parametrize("vocabulary", [["a"], ["a", "b", "é"], [f"w{i}_" for i in range(500)]])
def test_same_as_comparing_all_windows(spark, size, least, vocabulary):
    df = spark.createDataFrame([(p, t, 0, 0, 0) for p, t in files(size, vocabulary)], "path string, content string, row int, h int, mark int")
    columns = ["path", "start", "start_line", "end_line"]
    want = duplicates.repeated(duplicates.windows(df, size=size, min_lines=least), size=size).select(columns).collect()
    got = token_windows.repeated_windows(token_windows.token_table(df), size=size, min_lines=least)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    held = token_windows.table_of(duplicates.held_tokens(df))
    assert sorted(map(tuple, token_windows.repeated_windows(held, size=size, min_lines=least).collect())) == sorted(map(tuple, want))


def test_blocks_from_hashes(spark):
    df = spark.createDataFrame(files(3, ["a", "b"]) + files(4, [f"w{i}" for i in range(90)])[:9], "path string, content string").dropDuplicates(["path"])
    table = token_windows.token_table(df)
    spans = duplicates.token_intervals(token_windows.repeated_windows(table, size=10, min_lines=2), size=10)
    rows = lambda held: sorted(tuple(r)[1:] for r in duplicates.blocks(spans, held, min_lines=2).collect())
    assert rows(table) == rows(duplicates.held_tokens(df)) != []


def test_tokens():
    text = "ab_1 é漢 , x.y\r\n\nfoo🙂baŕ z q\n"
    h, line = token_windows.tokens(text.encode())
    said = [(m, i + 1) for i, part in enumerate(regex.split("\r?\n", text)) for m in regex.findall(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\t\n\x0B\f\r ]", part)]
    assert len(h) == len(said) and list(line) == [n for _, n in said]
    assert len(token_windows.tokens(b"")[0]) == 0 and len(token_windows.tokens(b"a\xffb\xfe")[0]) == 4
    again, _ = token_windows.tokens(b"x foo z foo")
    assert again[1] == again[3] and len(set(again)) == 3


def test_minima():
    g = np.random.default_rng(1).integers(0, 5, 200)
    for width in (1, 2, 3, 7, 50, 51, 200):
        assert list(token_windows.leftmost_minima(g, width)) == [i + int(np.argmin(g[i : i + width])) for i in range(len(g) - width + 1)]


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, content string")
    assert token_windows.repeated_windows(token_windows.token_table(none), size=10, min_lines=1).count() == 0


def test_files_that_are_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(token_windows, "SENT", 0)
    df = spark.createDataFrame(files(5, [f"w{i}_" for i in range(300)]), "path string, content string")
    want = duplicates.repeated(duplicates.windows(df, size=10, min_lines=2), size=10).select("path", "start", "start_line", "end_line").collect()
    assert sorted(map(tuple, token_windows.repeated_windows(token_windows.token_table(df), size=10, min_lines=2).collect())) == sorted(map(tuple, want)) != []
