"""Duplicate blocks: token windows that recur, merged into intervals of lines.

A file's tokens are one row (path, t: texts, l: lines). ``windows`` lists all windows, as
slices with a digest each; ``repeated_windows`` of ``token_windows`` finds those that
recur from a table of token hashes, without listing the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import written

#: Tokens of a window, lines that it must span, and blocks that a report lists.
WINDOW, MIN_LINES, LISTED = 100, 6, 100
#: A word, or any other character that is not white space (spelt out: dialects differ).
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\t\n\x0B\f\r ]"
_SEP = "\x01"


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))


def held_tokens(files: DataFrame) -> DataFrame:
    """path, t, l of each file, by words and characters: for text of any language."""
    lines = F.split(F.col("content"), "\r?\n")
    toks = F.flatten(F.transform(lines, lambda x, i: F.transform(_tokens(x), lambda t: F.struct(t.alias("t"), (i + 1).alias("line")))))
    return files.select("path", toks.alias("k")).select("path", F.col("k.t").alias("t"), F.col("k.line").alias("l"))


def held_syntax(parsed: DataFrame) -> DataFrame:
    """The same of parsed Rust sources (rust_syntax.syntax)."""
    return parsed.select("path", F.col("tokens.t").alias("t"), F.col("tokens.line").alias("l"))


def windows_of(held: DataFrame, *, size: int = WINDOW, min_lines: int = MIN_LINES) -> DataFrame:
    """path, start, start_line, end_line, key of every window of ``size`` tokens over at
    least ``min_lines`` lines. Files with fewer tokens, and null content, have none."""
    at = held.where(F.size("t") >= size).select("path", "t", "l", F.explode(F.sequence(F.lit(0), F.size("t") - size)).alias("start"))
    first, last = F.get("l", F.col("start")), F.get("l", F.col("start") + size - 1)
    return at.where(F.greatest(last - first, F.lit(0)) + 1 >= min_lines).select("path", "start", first.alias("start_line"), last.alias("end_line"), F.md5(F.array_join(F.slice("t", F.col("start") + 1, size), _SEP)).alias("key"))


def windows(files: DataFrame, *, size: int = WINDOW, min_lines: int = MIN_LINES) -> DataFrame:
    return windows_of(held_tokens(files), size=size, min_lines=min_lines)


def repeated_keys(found: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """Keys that are in several files, or a window apart in one."""
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("windows"), F.min("path").alias("p1"), F.max("path").alias("p2"), F.min("start").alias("s1"), F.max("start").alias("s2"))
    return keys.where(f"p1 <> p2 or s2 - s1 >= {size}").select("key", "windows")


def repeated(found: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """Windows whose key is also in another file, or a window away in the same one."""
    return found.join(repeated_keys(found, size=size).select("key"), "key", "left_semi")


def token_intervals(hits: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """path, start, end (of tokens, end exclusive), start_line, end_line of the unions of
    overlapping or touching windows, from the line of the first token to that of the last."""
    order = Window.partitionBy("path").orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    new = hits.withColumn("e", F.lag("start").over(order) + size).withColumn("new", F.when(F.col("e").isNull() | (F.col("start") > F.col("e")), 1).otherwise(0))
    merged = new.withColumn("island", F.sum("new").over(upto)).groupBy("path", "island")
    return merged.agg(F.min("start").alias("start"), (F.max("start") + size).alias("end"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def line_intervals(spans: DataFrame) -> DataFrame:
    """path, start_line, end_line: what overlaps or touches as lines is merged."""
    before = Window.partitionBy("path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.groupBy("path", "start_line").agg(F.max("end_line").alias("end_line"))
    new = spans.withColumn("e", F.max("end_line").over(before)).withColumn("new", F.when(F.col("e").isNull() | (F.col("start_line") > F.col("e") + 1), 1).otherwise(0))
    return new.withColumn("island", F.sum("new").over(upto)).groupBy("path", "island").agg(F.min("start_line").cast("long").alias("start_line"), F.max("end_line").cast("long").alias("end_line")).drop("island")


def intervals(hits: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """path, start_line, end_line: windows are merged as tokens, and then as lines."""
    return line_intervals(token_intervals(hits, size=size))


def summary(merged: DataFrame) -> DataFrame:
    lines = F.coalesce(F.sum(F.expr("end_line - start_line + 1")), F.lit(0)).cast("long")
    return merged.agg(lines.alias("duplicate_lines"), F.count_distinct("path").alias("files_with_duplicates"), F.when(F.count(F.lit(1)) > 0, "fail").otherwise("pass").alias("status"))


def files(merged: DataFrame) -> DataFrame:
    """Files with duplicates, and their duplicate lines."""
    return merged.groupBy("path").agg(F.sum(F.expr("end_line - start_line + 1")).cast("long").alias("duplicate_lines"))


def keyed_spans(spans: DataFrame, held: DataFrame, *, min_lines: int = MIN_LINES) -> DataFrame:
    """path, start, start_line, end_line, tokens, key of token intervals over at least
    ``min_lines`` lines: equal keys, equal tokens."""
    wide = spans.where(F.col("end_line") - F.col("start_line") + 1 >= min_lines)
    cut = lambda c: F.slice(c, F.col("start") + 1, F.col("end") - F.col("start"))
    # A table of token hashes gives a key of two hashes over them.
    key, t = (F.array(F.xxhash64(cut("h")), F.xxhash64(F.lit(1), cut("h"))), "h") if "h" in held.columns else (F.md5(F.array_join(cut("t"), _SEP)), "t")
    return held.select("path", t).join(wide, "path").select("path", "start", "start_line", "end_line", (F.col("end") - F.col("start")).alias("tokens"), key.alias("key"))


def blocks(spans: DataFrame, held: DataFrame, *, min_lines: int = MIN_LINES) -> DataFrame:
    """Token intervals with one text, at least two of them: key, lines, tokens,
    occurrences, file and start_line of the first. Equal texts can span different numbers
    of lines; those of the last occurrence count."""
    place = F.struct("path", "start")
    found = keyed_spans(spans, held, min_lines=min_lines).groupBy("key").agg(
        F.max_by(F.col("end_line") - F.col("start_line") + 1, place).cast("long").alias("lines"), F.max("tokens").cast("long").alias("tokens"), F.count(F.lit(1)).alias("occurrences"),
        F.min_by("path", place).alias("path"), F.min_by("start_line", place).cast("long").alias("start_line"),
    )
    return found.where("occurrences >= 2")


def occurrences(spans: DataFrame, held: DataFrame, *, min_lines: int = MIN_LINES) -> DataFrame:
    """block, path, start_line, end_line of every occurrence of every block. A block is
    named by the file and the token that its first occurrence starts at."""
    keyed = keyed_spans(spans, held, min_lines=min_lines)
    first = F.min(F.struct("path", "start"))
    names = keyed.groupBy("key").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("key", F.concat_ws(":", "f.path", "f.start").alias("block"))
    return keyed.join(names, "key").select("block", "path", "start_line", "end_line")


def top_blocks(found: DataFrame, *, listed: int = LISTED) -> DataFrame:
    """The ``listed`` blocks with the most lines, then occurrences (ties by file and
    line), and how many blocks are left out: a report. The blocks are written first, so
    that they are found once."""
    found = written(found, "blocks")
    order = [F.col("lines").desc(), F.col("occurrences").desc(), "path", "start_line", "key"]
    many = found.agg(F.greatest(F.count(F.lit(1)) - listed, F.lit(0)).alias("omitted"))
    return found.orderBy(*order).limit(listed).join(many, F.lit(True)).select("path", "start_line", "lines", "tokens", "occurrences", "omitted")
