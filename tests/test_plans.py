from __future__ import annotations

import pytest

from siltstone.operators import duplicates, lines
from siltstone.plans import queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


def counts(spark, text):
    r = lines.classified(spark.createDataFrame([("a", text)], "path string, content string")).first()
    return r.total, r.blank, r.comment, r.code


def test_line_kinds(spark):
    assert counts(spark, "") == (0, 0, 0, 0)
    assert counts(spark, "a\r\n\r\nb\n") == (3, 1, 0, 2)
    # A line that starts with a comment and goes on with code leaves the comment open.
    assert counts(spark, "/* a\nb\n\n*/\ncode\n// c\n/* d */ code\ncode /* open\nx") == (9, 1, 7, 1)
    assert counts(spark, "code /* open\nx") == (2, 0, 0, 2)


def test_duplicates(spark):
    block = "\n".join(" ".join(f"t{i}_{k}" for k in range(12)) for i in range(10))
    files = spark.createDataFrame([("a", block), ("b", "x y\n" + block), ("c", "z")], "path string, content string")
    got = sorted(tuple(r) for r in duplicates.intervals(duplicates.repeated(duplicates.windows(files))).collect())
    assert got == [("a", 1, 10), ("b", 2, 11)]
    assert duplicates.summary(duplicates.intervals(duplicates.repeated(duplicates.windows(files.limit(0))))).first()[0] == 0
