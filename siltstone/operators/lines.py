"""Lines of files: splitting, classification, long lines, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import written

MAX_LINE = 100
MAX_FILE_LINES, MAX_CODE_LINES = 40, 30
LISTED = 200
_WHITE = r"[\t-\r \x{85}\p{Z}]+"


def split_lines(text: Column) -> Column:
    """Lines without their ends (LF or CRLF); no empty last line; no text, no lines."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def trim(line: Column) -> Column:
    return F.regexp_replace(line, f"^{_WHITE}|{_WHITE}$", "")


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files."""
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "lang", "source")


def lines_of(files: DataFrame) -> DataFrame:
    """path and others, line_no (from 1), line."""
    rest = [c for c in files.columns if c != "content"]
    return files.select(*rest, F.posexplode(split_lines(F.col("content"))).alias("at", "line")).select(*rest, (F.col("at") + 1).alias("line_no"), "line")


def classified(files: DataFrame, *, max_line: int = MAX_LINE) -> DataFrame:
    """Per file: total, blank, comment, code and long lines, and the longest in bytes.

    Each file's lines are folded in order within its row, so nothing is shuffled: the
    state is whether a block comment is open. It closes at a line that ends with */ and
    opens at one that starts with /*. A line becomes one number first (bit 1: blank, 2:
    starts with //, 4: starts with /*, 8: ends with */), so that it is trimmed once.
    """
    rest = [c for c in files.columns if c != "content"]
    long = lambda c: c.cast("long")
    held = files.select(*rest, split_lines(F.col("content")).alias("l"))
    held = held.select(*rest, F.transform("l", trim).alias("x"), F.transform("l", F.octet_length).alias("n"))
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    kind = lambda x: flag(x == "", 1) + flag(x.startswith("//"), 2) + flag(x.startswith("/*"), 4) + flag(x.endswith("*/"), 8)
    held = held.select(*rest, F.transform("x", kind).alias("k"), "n")
    has = lambda k, bit: k.bitwiseAND(bit) != 0
    # State: 1 if a comment is open, and twice the comment lines so far.
    opens = lambda s, k: F.when(has(k, 1), s % 2).when(has(k, 8), 0).when(has(k, 4), 1).otherwise(s % 2)
    step = lambda s, k: s - s % 2 + opens(s, k) + F.when(~has(k, 1) & ((s % 2 == 1) | has(k, 6)), 2).otherwise(0)
    blank = long(F.size(F.filter("k", lambda k: has(k, 1))))
    comment = long(F.floor(F.aggregate("k", F.lit(0), step) / 2))
    counted = held.select(*rest, long(F.size("k")).alias("total"), blank.alias("blank"), comment.alias("comment"), long(F.size(F.filter("n", lambda n: n > max_line))).alias("long"), long(F.coalesce(F.array_max("n"), F.lit(0))).alias("longest"))
    return counted.select(*rest, "total", "blank", "comment", (F.col("total") - F.col("blank") - F.col("comment")).alias("code"), "long", "longest")


def kinds(files: DataFrame) -> DataFrame:
    """path, line_no, kind of every line, by the same rule as a window over lines: for
    reports; ``classified`` counts without moving lines."""
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("x")
    event = F.when(x == "", None).when(x.endswith("*/"), False).when(x.startswith("/*"), True)
    held = lines_of(files.select("path", "content")).withColumn("x", trim(F.col("line"))).withColumn("event", event)
    opened = held.withColumn("open", F.coalesce(F.last("event", ignorenulls=True).over(order), F.lit(False)))
    kind = F.when(x == "", "blank").when(F.col("open") | x.startswith("//") | x.startswith("/*"), "comment").otherwise("code")
    return opened.select("path", F.col("line_no").cast("long").alias("line_no"), kind.alias("kind"))


def line_summary(counts: DataFrame, *keys: str) -> DataFrame:
    total = lambda k: F.coalesce(F.sum(k), F.lit(0)).cast("long")
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), total("total").alias("total_lines"), total("code").alias("code_lines"), total("comment").alias("comment_lines"), total("blank").alias("blank_lines"),
        total("long").alias("long_lines"), F.coalesce(F.max("longest"), F.lit(0)).cast("long").alias("max_line_length_found"), F.count_if(F.col("long") > 0).alias("files_with_long_lines"),
    )


def size_maxima(counts: DataFrame) -> DataFrame:
    most = lambda k: F.coalesce(F.max(k), F.lit(0)).cast("long")
    return counts.agg(F.count(F.lit(1)).alias("files"), most("total").alias("max_lines_per_file"), most("code").alias("max_code_lines_per_file"))


def long_lines(files: DataFrame, *, max_line: int = MAX_LINE, listed: int = LISTED) -> DataFrame:
    """The first ``listed`` long lines by path and number, and how many more there are:
    a report."""
    each = lines_of(files.select("path", "content")).withColumn("length", F.octet_length("line").cast("long")).where(F.col("length") > max_line)
    # Places and lengths are written, so that the texts are read once.
    found = written(each.select("path", F.col("line_no").cast("long").alias("line_no"), "length"), "long-lines")
    many = found.agg(F.greatest(F.count(F.lit(1)) - listed, F.lit(0)).alias("omitted"))
    return found.orderBy("path", "line_no").limit(listed).join(many, F.lit(True)).select("path", "line_no", "length", F.lit(max_line).cast("long").alias("threshold"), "omitted")


#: Limits on files: rule, column, what the message says (fixed values).
RULES = {
    "size:max-lines-per-file": ("total", "File has %d lines; maximum allowed is %d"),
    "size:max-code-lines-per-file": ("code", "File has %d code lines; maximum allowed is %d"),
}


def size_violations(counts: DataFrame, *, max_lines: int = MAX_FILE_LINES, max_code: int = MAX_CODE_LINES) -> DataFrame:
    """One row for each file and limit that it goes over."""
    limits = dict(zip(RULES, (max_lines, max_code), strict=True))
    rule = lambda r, k, says: F.struct(F.lit(r).alias("rule_id"), F.col(k).alias("actual"), F.lit(limits[r]).cast("long").alias("threshold"), F.format_string(says, k, F.lit(limits[r])).alias("message"))
    each = counts.select("path", F.explode(F.array(*[rule(r, k, says) for r, (k, says) in RULES.items()])).alias("v"))
    return each.where("v.actual > v.threshold").select("path", F.lit(1).cast("long").alias("line"), "v.rule_id", "v.actual", "v.threshold", "v.message", F.lit("major").alias("severity"))
