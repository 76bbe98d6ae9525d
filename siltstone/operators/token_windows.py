"""Token windows that recur, found without moving or slicing every window.

Files are read once and become a table of token hashes and lines. Hashes of ranges of
tokens come from prefix sums (a rolling hash), so that a window costs the same whatever
its size. Of each window, the least hash of its grams (half a window long) is its mark:
equal windows have equal marks, and neighbours mostly share theirs, so that some 4 of
100 windows of 100 tokens move in order to find the marks that are seen twice. Only
windows with such a mark get a key (128 bits over all their tokens) and are compared.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.lines import classified
from siltstone.sources.tables import dropped, written

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SPACE, _WORD, _MARK = 0, 1, 2
#: Tokens after which a batch goes back to Spark.
BATCH = 1 << 17
#: Files whose numbers are sent to all tasks, at most: some 32 MB.
SENT = 1 << 20


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of each code point: white space (six ASCII characters), part of a word
    (letters, marks, numbers, underscore), or a token of its own."""
    found = np.fromiter((_WORD if unicodedata.category(chr(i))[0] in "LMN" else _MARK for i in range(0x110000)), np.uint8, 0x110000)
    found[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
    found[ord("_")] = _WORD
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least ``size`` of them; kept."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        size = 1 << max(16, (size - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[base]


class Prefix:
    """Hashes of ranges of a sequence of 64-bit values: prefix sums of value times
    base**position, modulo 2**64, times the inverse power of the start."""

    def __init__(self, values: np.ndarray, base: int = _BASES[0]) -> None:
        up, self.down = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(_BASES[1]))


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line (from 1) of each token of a text: words, and other characters that
    aren't white space, one by one. A byte that isn't UTF-8 is such a character."""
    points = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[points]
    word, alone = kind == _WORD, kind == _MARK
    edge = np.zeros(len(points) + 2, bool)
    edge[1:-1] = word
    start = np.flatnonzero(alone | word & ~edge[:-2])
    end = np.flatnonzero(alone | word & ~edge[2:]) + 1
    line = np.cumsum(points == 0x0A, dtype=np.int32)[start] + 1
    return Prefix(mixed(points.astype(np.uint64) + np.uint64(1))).of(start, end), line


def leftmost_minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours, the place of the first that is least."""
    at, held = np.arange(len(g)), 1
    while held * 2 <= width:
        a, b = at[:-held], at[held:]
        at = np.where(g[b] < g[a], b, a)
        held *= 2
    if held < width:
        a, b = at[: len(g) - width + 1], at[width - held :]
        at = np.where(g[b] < g[a], b, a)
    return at


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield values[a:b]


def _listed(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate(rows) if rows else [], kind))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo, many, found = 0, 0, []
        for i, text in enumerate(batch.column(2)):
            found.append(tokens(text.as_py() or b""))
            many += len(found[-1][0])
            if many >= BATCH or i + 1 == batch.num_rows:
                columns = [_listed([h.view(np.int64) for h, _ in found], pa.int64()), _listed([line for _, line in found], pa.int32())]
                rest = [k for k in range(batch.num_columns) if k != 2]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(k).slice(lo, i + 1 - lo) for k in rest)], ["h", "l", *(batch.schema.names[k] for k in rest)])
                lo, many, found = i + 1, 0, []


def token_table(files: DataFrame, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """row (a number of its own), path, h (token hashes), l (their lines) of each file,
    and the columns in ``carry``, written: the one time that the texts are read. Null
    content has no tokens."""
    rows = files.select(F.monotonically_increasing_id().alias("row"), "path", F.col("content").cast("binary").alias("content"), *carry)
    kept = rows.drop("content").schema
    schema = ", ".join(["h array<long>, l array<int>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    return written(rows.mapInArrow(_hashed, schema), "token-table")


def measured_table(files: DataFrame, **limits: int) -> DataFrame:
    """``token_table`` with the line counts of each file (lines.classified) and its other
    columns: all that the collectors on texts need, from one scan."""
    counts = classified(files.withColumn("body", F.col("content")), **limits).withColumnRenamed("body", "content")
    return token_table(counts, carry=tuple(c for c in counts.columns if c not in ("path", "content")))


def table_of(held: DataFrame) -> DataFrame:
    """The same of files whose tokens are known: path, t (texts), l (lines)."""
    rows = held.select(F.monotonically_increasing_id().alias("row"), "path", F.transform("t", lambda x: F.xxhash64(x)).alias("h"), F.col("l").cast("array<int>").alias("l"))
    return written(rows, "token-table")


def _marks(h: np.ndarray, line: np.ndarray, size: int, min_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows over enough lines, and the place and hash of their marks."""
    none = np.zeros(0, np.int64)
    if len(h) < size:
        return none, none, none
    gram = (size + 1) // 2
    start = np.arange(len(h) - gram + 1)
    g = Prefix(h.view(np.uint64)).of(start, start + gram)
    place = leftmost_minima(g, size - gram + 1)
    wide = np.flatnonzero(np.maximum(line[size - 1 :] - line[: len(line) - size + 1], 0) + 1 >= min_lines)
    return wide, place[wide], g[place[wide]].view(np.int64)


def _runs(size: int, min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, h, line in zip(batch.column(0).to_pylist(), _lists(batch.column(1)), _lists(batch.column(2)), strict=True):
                start, place, mark = _marks(h, line, size, min_lines)
                if len(start):
                    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
                    last = np.append(first[1:], len(start)) - 1
                    out.append((np.full(len(first), row), mark[first], start[first], start[last]))
            if out:
                row, mark, lo, hi = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(mark, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["row", "mark", "lo", "hi"])

    return run


def _keyed(size: int):
    names = ["path", "start", "start_line", "end_line", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (h, line, lo, hi) in enumerate(zip(*(_lists(batch.column(k)) for k in range(1, 5)), strict=True)):
                first, many = np.sort(lo).astype(np.int64), np.sort(hi).astype(np.int64) - np.sort(lo) + 1
                start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)
                keys = [Prefix(h.view(np.uint64), base).of(start, start + size).view(np.int64) for base in _BASES]
                path = pa.array([batch.column(0)[i].as_py()], pa.string())
                columns = [pa.DictionaryArray.from_arrays(np.zeros(len(start), np.int32), path).cast(pa.string()), pa.array(start, pa.int32()), pa.array(line[start], pa.int32()), pa.array(line[start + size - 1], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, keys)], names)

    return run


def candidates(table: DataFrame, *, size: int, min_lines: int) -> DataFrame:
    """path, start, start_line, end_line, k1, k2 of the windows whose mark is seen at
    two places at least; written. No repeated window is missing: equal windows choose
    the same gram, at the same place within them."""
    marks = written(table.select("row", "h", "l").mapInArrow(_runs(size, min_lines), "row long, mark long, lo int, hi int"), "window-marks")
    twice = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("mark")
    runs = written(marks.join(twice, "mark", "left_semi").groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("r")), "window-runs")
    # Most files have no such window: where their numbers can be sent to all tasks, the
    # others stay where they are.
    held = table.join(F.broadcast(runs.select("row")), "row", "left_semi") if runs.count() <= SENT else table
    held = held.join(runs, "row").select("path", "h", "l", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    found = written(held.mapInArrow(_keyed(size), "path string, start int, start_line int, end_line int, k1 long, k2 long"), "window-keys")
    dropped(marks, runs)
    return found


def repeated_windows(table: DataFrame, *, size: int, min_lines: int) -> DataFrame:
    """path, start, start_line, end_line of every window of ``size`` tokens over at
    least ``min_lines`` lines that is also in another file, or ``size`` tokens away in
    the same one."""
    found = candidates(table, size=size, min_lines=min_lines).withColumn("file", F.xxhash64("path"))
    keys = found.groupBy("k1", "k2").agg(F.min("file").alias("f1"), F.max("file").alias("f2"), F.min("start").alias("s1"), F.max("start").alias("s2"))
    kept = keys.where(f"f1 <> f2 or s2 - s1 >= {size}").select("k1", "k2")
    return found.join(kept, ["k1", "k2"], "left_semi").select("path", "start", "start_line", "end_line")
