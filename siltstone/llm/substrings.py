"""Repeated passages by suffix arrays over shards.

A passage of ``length`` bytes has an anchor, the first k-gram in it with the least hash;
equal passages have equal anchors. Passages next to each other with one anchor are a
stretch of text. So only stretches whose anchor anchors another one can hold repeats, and
of equal stretches only one must be compared with others.
They go to the shard of their k-gram, where a suffix array (doubling that re-sorts only
what is still tied, after Larsson and Sadakane) and Kasai's common prefixes find equal
passages. A k-gram with more text than a shard holds has several shards; their sorted
passages are merged by binary search.

Texts are read again from the input for each of three scans, and moved once, at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import discard, map_arrow, materialise
from siltstone.llm.textscan import Chunk, Rolling, chunks, mix

#: Bytes of a repeated passage, of the k-gram that anchors it, and of a shard.
LENGTH, KGRAM, SHARD_BYTES = 100, 32, 2 << 20
#: Bits of the two bitmaps of k-grams that are sent to all workers: 16 MB each, whatever
#: the size of the input. What shares a bit with a wanted k-gram passes; joins drop it.
BITMAP_BITS = 27
#: Bytes of text that are scanned at a time. A longer text is scanned by itself.
SCAN_BYTES = 2 << 20


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i, in log(width) passes."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def anchored(c: Chunk, roll: Rolling, length: int, kgram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All stretches of a chunk's texts: the hash of the anchor, start, end, the text's
    number. Each passage of ``length`` bytes within a text is in one stretch."""
    if len(c.raw) < length:
        return (np.zeros(0, np.int64),) * 4
    h = roll.every(kgram)
    # Half of the hash above the place: the least is the first of the least.
    key = h & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(h), dtype=np.uint64)
    place = _least(key, length - kgram + 1).astype(np.uint32)
    over = np.zeros(len(place), bool)  # over the end of a text
    for b in c.bounds[1:-1]:
        over[max(0, b - length + 1) : b] = True
    ends = np.ones(len(place) + 1, bool)  # a stretch ends before here
    ends[1:-1] = place[1:] != place[:-1]
    ends[:-1] |= over
    ends[1:-1] |= over[:-1]
    cuts = np.flatnonzero(ends)
    start, end = cuts[:-1], cuts[1:]
    ok = ~over[start]
    start, end = start[ok], end[ok] - 1 + length
    return h[place[start]].view(np.int64), start, end, np.searchsorted(c.bounds, start, "right") - 1


def _counted(length: int, kgram: int):
    """Anchors of each chunk's stretches with 1, or 2 where several have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, c in chunks(batch.column(2), words=False, limit=SCAN_BYTES):
                h, n = np.unique(anchored(c, Rolling(c.raw), length, kgram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])

    return run


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the column h, by its low bits."""
    low = F.col("h").bitwiseAND((1 << bits) - 1)
    words = hashes.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(1 << (bits - 6), np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found


def _stretches(bitmap, length: int, kgram: int, bits: int, blobs: bool):
    """Of each chunk's stretches with a wanted anchor (bitmap), the first of equal ones: h,
    g (a hash of the stretch), d, s, start, end, and the bytes if ``blobs``. The others
    start later than an equal one: without ``blobs`` they come as ranges to remove, under
    a null h, those that touch merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bitmap.value
        for batch in batches:
            for lo, hi, c in chunks(batch.column(2), words=False, limit=SCAN_BYTES):
                roll = Rolling(c.raw)
                found = anchored(c, roll, length, kgram)
                ok = (wanted[(found[0] & ((1 << bits) - 1)) >> 6] >> (found[0] & 63)) & 1 == 1
                h, start, end, owner = (x[ok] for x in found)
                g = roll.of(start, end).view(np.int64)
                d, s = batch.column(0).slice(lo, hi - lo).to_numpy(), batch.column(1).slice(lo, hi - lo).to_numpy()
                names, doc = np.unique(np.stack([d, s], 1), axis=0, return_inverse=True)
                doc = doc.ravel()[owner]
                inner = start - c.bounds[owner]
                order = np.lexsort((inner, doc, g, h))
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
                head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
                first = order[new]
                columns = [h[first], g[first], d[owner[first]], s[owner[first]], inner[first], (end - c.bounds[owner])[first]]
                if blobs:
                    raw = c.raw.tobytes()
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([raw[a:b] for a, b in zip(start[first], end[first], strict=True)], pa.binary())], ["h", "g", "d", "s", "start", "end", "blob"])
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["h", "g", "d", "s", "start", "end"])
                again = order[(doc[order] != doc[head]) | (inner[order] != inner[head])]
                a, b, who = merged(doc[again], inner[again], (end - c.bounds[owner])[again])
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(names[who, 0], pa.int64()), pa.array(names[who, 1], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["h", "g", "d", "s", "start", "end"])

    return run


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the ranges of each document that overlap or touch: start, end, document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = doc * (1 << 40)
    reach = np.maximum.accumulate(base + end) if len(end) else end
    new = np.ones(len(doc), bool)
    new[1:] = (base + start)[1:] > reach[:-1]
    last = np.append(new[1:], True)[: len(new)]
    return start[new], (reach - base)[last], doc[new]


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(len(text), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + len(text)].astype(np.uint64)
    return key


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in their order. Starts from eight bytes; each round doubles the depth and
    re-sorts the groups that are still tied. The order is whole (Kasai's scan needs it)."""
    n = len(text)
    key = _words(text)
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new[:-1], np.arange(n), 0))
    where, h = np.flatnonzero(~(new[:-1] & new[1:])), 8
    while len(where):
        # Group and rank of what follows in one number: one sort for both.
        idx = sa[where]
        pair = rank[idx] << 32
        inside = idx + h < n
        pair[inside] += rank[idx[inside] + h] + 1
        order = np.argsort(pair)
        idx, pair = idx[order], pair[order]
        sa[where] = idx
        new = np.ones(len(where) + 1, bool)
        new[1:-1] = pair[1:] != pair[:-1]
        rank[idx] = where[np.maximum.accumulate(np.where(new[:-1], np.arange(len(where)), 0))]
        where = where[~(new[:-1] & new[1:])]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Kasai's scan: how many bytes each suffix shares with the one before it in ``sa``,
    up to ``most``. A suffix shares at least one byte less than the suffix one place to
    the left did, so no byte is compared twice. The pieces of text that begin at
    ``starts`` are scanned side by side, eight bytes at a step."""
    n = len(text)
    rank, words = np.empty(n, np.int64), np.append(_words(text), np.zeros(most + 8, np.uint64))
    rank[sa] = np.arange(n)
    shared = np.zeros(n, np.int64)
    size = np.diff(np.append(starts, n))
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    have = np.zeros(len(starts), np.int64)
    for k in range(int(size[0]) if n else 0):
        many = int(np.searchsorted(-size, -k, side="left"))
        i = starts[:many] + k
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        have = np.maximum(have[:many] - 1, 0)
        stop = np.where(r > 0, np.minimum(most, n - np.maximum(i, j)), 0)
        left = np.flatnonzero(have < stop)
        while len(left):
            x = words[i[left] + have[left]] ^ words[j[left] + have[left]]
            same = np.full(len(left), 8)
            for byte in range(8):
                same[x >= np.uint64(1 << (8 * byte))] = 7 - byte
            have[left] += same
            left = left[(same == 8) & (have[left] < stop[left])]
        have = np.minimum(have, stop)
        shared[r] = have
    return shared


def _repeats(blobs: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the passages of a shard in order: number of the blob, offset in it, whether it
    also starts earlier in the shard (a smaller doc, or the same and a smaller place), and
    its place in the joined text. Blobs of one document may overlap: the same place in a
    document is not earlier."""
    text = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(blobs)), sizes)
    offset = np.arange(len(text)) - starts[owner]
    whole = offset + length <= sizes[owner]
    sa = suffix_array(text)
    group = np.cumsum(common_prefixes(text, sa, starts, length) < length)
    inside = whole[sa]
    sa, group = sa[inside], group[inside]
    place = (doc[owner[sa]] << 40) + start[owner[sa]] + offset[sa]
    head = np.flatnonzero(np.diff(group, prepend=-1))
    again = np.zeros(len(text), bool)
    if len(head):
        again[sa] = place != np.repeat(np.minimum.reduceat(place, head), np.diff(np.append(head, len(group))))
    at = np.flatnonzero(whole)
    return owner[at], offset[at], again[at], at


def _sharded(length: int, limit: int):
    """Rows (h, g, d, s, start, end, blob, salt, salts) in the order of h, salt, g, d, s,
    start -> ranges to remove (d, s, start, end), and for k-grams with several shards the
    passages that are first in theirs: h, part, and packed, in the order of their keys, key,
    d, s, start. Of equal stretches the first is compared; the others are known to go."""

    def done(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        d, s, start = (np.array([r[k] for r in rows], np.int64) for k in ("d", "s", "start"))
        names, doc = np.unique(np.stack([d, s], 1), axis=0, return_inverse=True)
        doc = doc.ravel()
        owner, offset, hit, at = _repeats([r["blob"] for r in rows], doc, start, length)
        o, f = owner[hit], offset[hit]
        a, b, who = merged(doc[o], start[o] + f, start[o] + f + length)
        yield _rows(d=names[who, 0], s=names[who, 1], start=a, end=b)
        parts = rows[0]["salts"]
        if parts <= 1:
            return
        text = np.frombuffer(b"".join(r["blob"] for r in rows), np.uint8)
        one = Rolling(text).of(at[~hit], at[~hit] + length)
        two = Rolling(np.uint8(255) - text).of(at[~hit], at[~hit] + length)
        o, f = owner[~hit], offset[~hit]
        part = (mix(one.copy()) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((two, one, part))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for k in range(parts):
            x = order[cuts[k] : cuts[k + 1]]
            if len(x):
                packed = [np.stack([one[x], two[x]], 1).tobytes(), d[o[x]].tobytes(), s[o[x]].tobytes(), (start[o[x]] + f[x]).tobytes()]
                yield _rows(h=[rows[0]["h"]], part=[k], keys=[packed[0]], ds=[packed[1]], ss=[packed[2]], starts=[packed[3]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if rows and (row["h"], row["g"]) == (rows[-1]["h"], rows[-1]["g"]):
                    continue
                # A k-gram with several shards never shares one.
                if rows and (row["h"], row["salt"]) != (rows[-1]["h"], rows[-1]["salt"]) and (size >= limit or row["salts"] > 1 or rows[-1]["salts"] > 1):
                    yield from done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row["blob"])
        if rows:
            yield from done(rows)

    return run


_SHARDED = pa.schema([("h", pa.int64()), ("part", pa.int64()), ("d", pa.int64()), ("s", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("keys", pa.binary()), ("ds", pa.binary()), ("ss", pa.binary()), ("starts", pa.binary())])


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SHARDED], schema=_SHARDED)


def _merged_runs(length: int):
    """Runs of passages in the order of h, part: each run's passages are looked up by
    binary search in what the runs before hold. Of equal ones all but the first go."""
    kind = np.dtype([("one", np.uint64), ("two", np.uint64)])

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        d, s, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
        names, doc = np.unique(np.stack([d, s], 1), axis=0, return_inverse=True)
        a, b, who = merged(doc.ravel(), start, start + length)
        return pa.RecordBatch.from_arrays([pa.array(names[who, 0]), pa.array(names[who, 1]), pa.array(a), pa.array(b)], ["d", "s", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, places, gone = None, None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                k = np.frombuffer(row["keys"], kind)
                v = np.stack([np.frombuffer(row[x], np.int64) for x in ("ds", "ss", "starts")])
                if now != (row["h"], row["part"]):
                    if gone:
                        yield out(gone)
                    now, keys, places, gone = (row["h"], row["part"]), k, v.copy(), []
                    continue
                spot = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                known = keys[spot] == k
                mine, theirs = v[:, known], places[:, spot[known]]
                # Which of the two comes first in (d, s, start)?
                first = np.zeros(mine.shape[1], bool)
                tied = np.ones(mine.shape[1], bool)
                for x, y in zip(mine, theirs, strict=True):
                    first |= tied & (x < y)
                    tied &= x == y
                lost = np.where(first, theirs, mine)[:, ~tied]
                gone.append(tuple(lost))
                places[:, spot[known]] = np.where(first, mine, theirs)
                where = np.searchsorted(keys, k[~known])
                keys, places = np.insert(keys, where, k[~known]), np.insert(places, where, v[:, ~known], axis=1)
        if gone:
            yield out(gone)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
            for start, end in sorted(zip(starts or [], ends or [], strict=True)):
                if start > at or not spans:
                    kept.update(text[at:start])
                    spans += 1
                removed += max(0, end - max(at, start))
                at = max(at, end)
            kept.update(text[at:])
            for values, x in zip(out, (doc, len(text), removed, spans, kept.hexdigest()), strict=True):
                values.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(rows: DataFrame, *, length: int = LENGTH, kgram: int = KGRAM, shard_bytes: int = SHARD_BYTES, bits: int = BITMAP_BITS) -> DataFrame:
    """From (d, s, text), d and s the order of documents, all ranges to remove: d, s,
    start, end. They may overlap."""
    sc = rows.sparkSession.sparkContext
    scan = lambda run, schema: map_arrow(rows, run, schema)
    # 1. k-grams that anchor twice.
    twice = scan(_counted(length, kgram), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    bitmap = sc.broadcast(_bitmap(twice, bits))
    # 2. Equal stretches: all but the first of them go whole.
    found = materialise(scan(_stretches(bitmap, length, kgram, bits, False), "h long, g long, d long, s long, start long, end long"), "repeats-found")
    classes = found.where("h is not null")
    place = F.struct("d", "s", "start")
    # Tasks find the first of their own before a stretch's rows meet; then one row of each
    # class meets the others.
    firsts = classes.groupBy("h", "g").agg(F.min(place).alias("first"))
    later = classes.join(firsts, ["h", "g"]).where(place != F.col("first"))
    # 3. k-grams with different stretches: these are compared in shards.
    several = classes.groupBy("h").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 <> g2").select("h")
    mixed = sc.broadcast(_bitmap(several, bits))
    blobs = materialise(scan(_stretches(mixed, length, kgram, bits, True), "h long, g long, d long, s long, start long, end long, blob binary"), "repeats-blobs")
    hot = blobs.groupBy("h").agg(F.sum(F.length("blob")).alias("bytes")).where(F.col("bytes") > shard_bytes).select("h", F.ceil(F.col("bytes") / shard_bytes).cast("long").alias("salts"))
    salted = blobs.join(hot, "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod("g", "salts"))
    shards = salted.repartition("h", "salt").sortWithinPartitions("h", "salt", "g", "d", "s", "start")
    schema = "h long, part long, d long, s long, start long, end long, keys binary, ds binary, ss binary, starts binary"
    sharded = materialise(map_arrow(shards, _sharded(length, shard_bytes), schema), "repeats-sharded")
    runs = sharded.where("keys is not null").select("h", "part", "keys", "ds", "ss", "starts").repartition("h", "part").sortWithinPartitions("h", "part")
    across = map_arrow(runs, _merged_runs(length), "d long, s long, start long, end long")
    names = ["d", "s", "start", "end"]
    every = found.where("h is null").select(names).unionByName(later.select(names)).unionByName(sharded.where("keys is null").select(names)).unionByName(across)
    # One row for each document: its ranges are no more than its bytes.
    ranges = materialise(every.groupBy("d", "s").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "repeats-ranges")
    discard(found, blobs, sharded)
    bitmap.destroy()
    mixed.destroy()
    return ranges


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Return per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a ``length``-byte string over it also starts earlier: in a document
    of a smaller id, or before in the same one. Matches stay within documents.

    * null text is empty; texts shorter than ``length`` stay
    * rows that repeat id and text are one document; rows with one id and several texts
      are in the order of a hash of the text; null ids come last
    * an empty table gives an empty result; other columns are ignored
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), order.alias("d"), F.xxhash64(raw).alias("s"), raw.alias("text"))
    ranges = repeated_ranges(rows.select("d", "s", "text"), **options)
    found = rows.join(ranges, ["d", "s"], "left").select("doc_id", "text", "starts", "ends")
    return map_arrow(found, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
