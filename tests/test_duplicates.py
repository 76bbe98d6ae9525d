from __future__ import annotations

from siltstone.operators import duplicates


def test_touching_windows_are_one_interval(spark):
    part = lambda k: "\n".join(" ".join(f"{k}{i}_{j}" for j in range(10)) for i in range(10))
    files = [("a", part("p") + "\n\n" + part("q")), ("b", part("p")), ("c", part("q")), ("d", part("p") + "\nx\n\n" + part("q"))]
    found = duplicates.windows(spark.createDataFrame(files, "path string, content string"))
    # Windows of a over the seam are in no other file; a token between keeps d's apart.
    merged = duplicates.intervals(duplicates.repeated(found))
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 1, 21), ("b", 1, 10), ("c", 1, 10), ("d", 1, 10), ("d", 13, 22)]
    assert duplicates.summary(merged).first()[0] == 61
