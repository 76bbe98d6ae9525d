"""Which lines lie in which intervals, by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a bin.
BIN = 64


def lines_in(intervals: DataFrame, lines: DataFrame, *, size: int = BIN) -> DataFrame:
    """The columns of intervals (path, start_line, end_line, ...) and of lines (path,
    line_no, ...) for each line of an interval, both ends included.

    An interval becomes one row for each bin that it reaches into, a line lies in one
    bin: so they meet by equal path and bin, a long interval is spread over tasks, and
    no line meets an interval twice. An interval that ends before it starts has no lines.
    """
    bin_of = lambda c: F.floor(F.col(c) / size).cast("long")
    spread = intervals.where("start_line <= end_line").withColumn("bin", F.explode(F.sequence(bin_of("start_line"), bin_of("end_line"))))
    met = spread.join(lines.withColumn("bin", bin_of("line_no")), ["path", "bin"])
    return met.where("line_no between start_line and end_line").drop("bin")
