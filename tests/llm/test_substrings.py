from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from siltstone.llm import substrings

SCHEMA = "doc_id long, text string, s int"


def brute(rows, length):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_against_brute_force(spark, shard):
    r = random.Random(6)
    said = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    common, rows = said(150), []
    for _ in range(60):
        parts = [said(r.randrange(150)) for _ in range(3)]
        rows.append((len(rows) * 3, parts[0] + (common[r.randrange(30) :] if r.random() < 0.5 else "") + parts[1] + r.choice(["", parts[0], "aaaa" * 40, rows[r.randrange(len(rows))][1] if rows else ""]), 0))
    rows += [(1, None, 0), (2, "", 0), (4, rows[9][1], 0), (5, rows[9][1], 0), (7, "ab", 0)]
    got = {x.doc_id: tuple(x)[1:] for x in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), shard_bytes=shard).collect()}
    assert got == brute(rows, 100)


def test_nulls_repeats_and_long_texts(spark):
    r = random.Random(8)
    said = "".join(r.choice("abcdefgh") for _ in range(700))
    rows = [(3, said, 0), (3, said, 0), (None, said, 0), (9, "x" * 30_000 + said[:150], 0), (5, None, 0), (5, "other" + said[100:300], 0), (6, "x" * 120, 0)]
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans) for x in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(False, 3, 700, 0, 0)] * 2 + [(False, 5, 0, 0, 0), (False, 5, 205, 200, 1), (False, 6, 120, 119, 1), (False, 9, 30_150, 30_150, 1), (True, 0, 700, 700, 1)]


def test_common_prefixes_against_definition():
    r = random.Random(2)
    pieces = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(30)] + [b"a" * 200]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum([0] + [len(p) for p in pieces])[:-1]
    sa = substrings.suffix_array(text)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text.tobytes()[i:])
    got, raw = substrings.common_prefixes(text, sa, starts, 40), text.tobytes()
    for k in range(1, len(sa)):
        a, b = raw[sa[k - 1] :][:40], raw[sa[k] :][:40]
        assert got[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
