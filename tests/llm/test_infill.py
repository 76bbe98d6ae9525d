from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import infill

SCHEMA = "doc_id long, text string, n int, form string, draws int, output int"


def brute(doc, text, units):
    """What a text becomes, one unit after the other."""
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = units(text)
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    spm = h[3] % 100 < 20
    return doc, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def by_class(text):
    kind = lambda c: 0 if c.isspace() else 1 if "0" <= c <= "9" else 2 if ord(c) < 128 and not c.isalpha() else 3
    out = []
    for c in text:
        if out and kind(out[-1][-1]) == kind(c):
            out[-1] += c
        else:
            out.append(c)
    return out


@pytest.mark.parametrize(("unit", "units"), [("codepoint", list), ("class", by_class)])
def test_against_brute_force(spark, unit, units):
    r = random.Random(4)
    say = lambda n: "".join(r.choice("ab 12é漢🙂<PSM>\n.,") for _ in range(n))
    rows = [(i, say(r.randrange(0, 60))) for i in range(300)] + [(None, "no id at all"), (None, None), (500, None), (501, ""), (502, "a<S>b"), (7, "same id"), (7, "same id"), (503, "<P" * 30), (504, "é🙂 9" * 60_000)]
    docs = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows], SCHEMA)
    made = infill.fill_in_middle(docs, unit=unit).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted((tuple(x)[:6] for x in made), key=key) == sorted((brute(d, t, units) for d, t in rows), key=key)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.restored) for x in made) == sorted((d is None, d or 0, t or "") for d, t in rows)
    assert {x.form for x in made} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_bytes_that_are_not_text_come_back():
    for raw in (b"a\xff\xfeb", "é".encode()[:1], "🙂".encode() + b"\x80", b""):
        assert infill.encode(infill.decode(raw)) == raw
    assert len(infill.decode(b"a\xff")) == 2
    assert list(infill.ends(infill.decode("ab  12".encode()), "class")) == [0, 2, 4, 6]
    assert list(infill.ends(np.zeros(0, np.uint32), "codepoint")) == [0]
    with pytest.raises(ValueError, match="unit"):
        infill.classes(infill.decode(b"a"), "word")


def test_other_marks_and_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", f"text {i} <P> " * 3) for i in range(40)], "name string, body string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    made = infill.fill_in_middle(docs, id_col="name", text_col="body", marks=marks, rate=100, suffix_first=50)
    got = made.withColumn("restored", infill.restore(F.col("output"), F.col("form"), marks=marks)).collect()
    assert {x.restored for x in got} == {f"text {i} <P> " * 3 for i in range(40)} and {x.form for x in got} == {"psm", "spm"}
    assert made.schema["doc_id"].dataType.simpleString() == "string"
