"""Class-based n-grams (Brown): exchange clustering, class transitions, word emissions.

Texts are read once and written as chunks: a chunk's words as numbers in its own
dictionary of distinct words. Words are dealt to buckets by a hash. In each round a chunk
sends every bucket one packed row with its words' counts and contexts, the bucket moves
its words between classes, and answers each chunk with one packed row of classes. So no
worker holds more than one chunk or one bucket, however large the vocabulary gets, and
what is moved is a few bytes for each different context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import discard, map_arrow, materialise
from siltstone.llm.textscan import chunks, mix

#: Classes, passes of exchange, share of the class model, and weight of class shares in
#: the smoothing of transitions.
CLASSES, ROUNDS, CLASS_SHARE, ALPHA = 64, 2, 0.85, 5.0
#: Bytes of text in a chunk (a longer text is a chunk of its own), dictionary entries of
#: all chunks in a bucket, on average, and parts of a bucket's tokens that move together:
#: a word with more tokens than that moves alone.
CHUNK_BYTES, BUCKET_WORDS, STEPS = 8 << 20, 150_000, 400
#: The name of the end token; a word has this hash with a chance of 2**-64.
END = -0x5EED0E0D

_ENCODED = "chunk string, docs array<long>, train array<boolean>, sizes array<long>, payload binary, h binary, n binary, seed binary"
_ASKED = "ctx int, times long, bucket int, chunk string, h binary, n binary, many binary, contexts binary, counts binary, seen binary"


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as four planes of bytes, compressed. Most are small, so the
    upper planes cost little."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def _unpack(packed: bytes | None) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    n = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold a chunk's bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _encode(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in _joined(batches):
            for lo, hi, c in chunks(batch.column(1), limit=CHUNK_BYTES):
                train = np.array(batch.column(2).slice(lo, hi - lo).to_pylist(), bool)
                u, place, local, times = np.unique(c.hashes(), return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(u), np.int64)
                rank[order] = np.arange(1, len(u) + 1)
                sizes = np.diff(c.first) + 1
                ids = np.zeros(int(sizes.sum()), np.int64)  # 0: the end of a text
                is_word = np.ones(len(ids), bool)
                is_word[np.cumsum(sizes) - 1] = False
                ids[is_word] = rank[local]
                n = np.bincount(ids[np.repeat(train, sizes)], minlength=len(u) + 1)
                first, last = c.data[c.start[place]].astype(int), c.data[c.end[place] - 1].astype(int)
                seed = (first * 31 + last * 7)[order] % classes
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": [f"{part}-{at}"], "docs": [batch.column(0).slice(lo, hi - lo)], "train": [train], "sizes": [sizes], "payload": [_pack(ids)],
                        "h": [np.concatenate([[END], u[order].view(np.int64)]).astype(np.int64).tobytes()], "n": [_pack(n)], "seed": [np.concatenate([[classes], seed]).astype(np.uint8).tobytes()],
                    },
                    pa.schema([("chunk", pa.string()), ("docs", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary()), ("h", pa.binary()), ("n", pa.binary()), ("seed", pa.binary())]),
                )
                at += 1

    return run


def _dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a chunk's words by bucket, and the buckets' bounds in it."""
    bucket = (mix(h.view(np.uint64).copy()) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _chunk_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[dict]:
    """Chunks with the class of each word, and its count if buckets have answered: the
    column ``answers`` has the answers of the buckets, in their order."""
    for batch in batches:
        for row in batch.to_pylist():
            h = np.frombuffer(row["h"], np.int64)
            found = {"chunk": row["chunk"], "docs": row["docs"], "train": np.array(row["train"], bool), "sizes": np.array(row["sizes"]), "ids": _unpack(row["payload"]), "h": h, "n": _unpack(row["n"])}
            if row.get("answers") is None:
                found["classes"] = np.frombuffer(row["seed"], np.uint8).astype(np.int64)
            else:
                order, _ = _dealt(h, buckets)
                said = sorted(row["answers"], key=lambda a: a["bucket"])
                for name, values in (("classes", np.frombuffer(b"".join(a["classes"] for a in said), np.uint8)), ("counts", np.concatenate([_unpack(a["counts"]) for a in said]))):
                    found[name] = np.empty(len(h), np.int64)
                    found[name][order] = values
            yield found


def _pairs(row: dict, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the chunk: its number, its class, the class before it. A text
    starts after an end."""
    cls = row["classes"][row["ids"]]
    before = np.empty_like(cls)
    before[:1], before[1:] = classes, cls[:-1]
    return row["ids"], cls, before


def _contexts(classes: int, buckets: int, words: bool):
    """Counts of (left class, class) for the chunk, and if asked a row for each bucket:
    its words, their counts, and how often each has each left and right class."""
    wide = classes + 1
    kinds = pa.schema([("ctx", pa.int32()), ("times", pa.int64()), ("bucket", pa.int32()), ("chunk", pa.string()), *[(k, pa.binary()) for k in ("h", "n", "many", "contexts", "counts", "seen")]])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches, buckets):
            ids, cls, before = _pairs(row, classes)
            taught = np.repeat(row["train"], row["sizes"])
            m, k = np.unique((before * wide + cls)[taught], return_counts=True)
            yield rows(ctx=m, times=k)
            if not words:
                continue
            order, bounds = _dealt(row["h"], buckets)
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            own = number[ids]
            follows = np.append(cls[1:], classes)
            word = taught & (ids > 0)
            both = np.concatenate([(own * 2 * wide + before)[word], (own * 2 * wide + wide + follows)[word]])
            m, k = np.unique(both, return_counts=True)
            many = np.bincount(m // (2 * wide), minlength=len(order))
            cuts = np.concatenate([[0], np.cumsum(many)])[bounds]
            out: dict[str, list] = {"bucket": [], "h": [], "n": [], "many": [], "contexts": [], "counts": [], "seen": []}
            for b in np.flatnonzero(np.diff(bounds)):
                mine, held = slice(bounds[b], bounds[b + 1]), slice(cuts[b], cuts[b + 1])
                for name, value in zip(out, (int(b), row["h"][order[mine]].tobytes(), _pack(row["n"][order[mine]]), _pack(many[mine]), _pack(m[held] % (2 * wide)), _pack(k[held]), row["classes"][order[mine]].astype(np.uint8).tobytes()), strict=True):
                    out[name].append(value)
            yield rows(chunk=[row["chunk"]] * len(out["h"]), **out)

    return run


def _logs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log transition probabilities, smoothed by class shares, and class sizes."""
    size = m.sum(0)
    share = size / max(1.0, size.sum())
    with np.errstate(divide="ignore"):
        return np.log((m + ALPHA * share) / (m.sum(1, keepdims=True) + ALPHA) + 1e-12), np.maximum(size, 1.0)


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def objective(m: np.ndarray) -> float:
    """What exchange makes larger: the part of the class model's log likelihood of the
    training tokens that depends on the classes."""
    return float(_entropy(m).sum() - _entropy(m.sum(0)).sum() - _entropy(m.sum(1)).sum())


def exchange(m: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, now: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """One pass over words (most frequent first), each of which is taken out of its class
    and put where the objective is highest; the counts of transitions m follow each move.

    left, right: for each word, how often each class is before and after it. Words with
    more than a share of 1 / ``steps`` of the tokens move one at a time, by the exact
    change of the objective; rarer ones in groups of at most that share, by its gradient.
    """
    classes = left.shape[1] - 1
    m, now = m.astype(float).copy(), now.copy()
    size = m.sum(0)[:classes]
    order = np.argsort(-n, kind="stable")
    group = np.floor(np.cumsum(n[order]) * (steps / max(1, n.sum())))
    lo = 0
    while lo < len(order):
        hi = min(max(lo + 1, int(np.searchsorted(group, group[lo], "right"))), lo + 4096)
        w = order[lo:hi]
        lo = hi
        a, b, k, c = left[w], right[w], n[w].astype(float), now[w]

        def move(c: np.ndarray, sign: int, a=a, b=b, k=k) -> None:
            into = np.zeros((classes, len(c)))
            into[c, np.arange(len(c))] = sign
            m[:, :classes] += (into @ a).T
            m[:classes] += into @ b
            size[:] += into @ k

        move(c, -1)
        np.maximum(m, 0, out=m)
        np.maximum(size, 0, out=size)
        if len(w) == 1:
            to, fro = m[:, :classes], m[:classes].T
            gain = (_entropy(to + a.T) - _entropy(to)).sum(0) + (_entropy(fro + b.T) - _entropy(fro)).sum(0) - 2 * (_entropy(size + k) - _entropy(size))
            best = np.array([np.argmax(gain)])
        else:
            gain = a @ np.log(m[:, :classes] + 0.1) + b @ np.log(m[:classes].T + 0.1) - 2 * k[:, None] * np.log(size + 1)
            best = np.argmax(gain, axis=1)
            stays = gain[np.arange(len(w)), best] <= gain[np.arange(len(w)), c] + 1e-9
            best = np.where(stays, c, best)
        move(best, 1)
        now[w] = best
    return now


def _answers(m: np.ndarray, classes: int):
    """A bucket's rows -> its words' new classes and counts, for each chunk that asked;
    and a row with the bucket's tokens and distinct words."""
    wide = classes + 1

    def done(rows: list[dict]) -> pa.RecordBatch:
        asked = [np.frombuffer(r["h"], np.int64) for r in rows]
        u, place = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.bincount(place, np.concatenate([_unpack(r["n"]) for r in rows]), len(u)).astype(np.int64)
        owner = np.repeat(place, np.concatenate([_unpack(r["many"]) for r in rows]))
        held = np.bincount(owner * 2 * wide + np.concatenate([_unpack(r["contexts"]) for r in rows]), np.concatenate([_unpack(r["counts"]) for r in rows]), len(u) * 2 * wide).reshape(len(u), -1)
        known = np.flatnonzero((n > 0) & (u != END))
        cls = np.zeros(len(u), np.int64)
        cls[place] = np.concatenate([np.frombuffer(r["seen"], np.uint8) for r in rows])
        cls[known] = exchange(m, held[known, :wide], held[known, wide:], n[known], cls[known])
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        out = zip(np.split(cls[place].astype(np.uint8), cuts), np.split(n[place], cuts), strict=True)
        found = [(x.tobytes(), _pack(y)) for x, y in out]
        k = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[0]["bucket"]] * (k + 1), pa.int32()), pa.array([r["chunk"] for r in rows] + [None], pa.string()), pa.array([x for x, _ in found] + [None], pa.binary()), pa.array([y for _, y in found] + [None], pa.binary()), pa.array([None] * k + [int(n.sum())], pa.int64()), pa.array([None] * k + [int((n > 0).sum())], pa.int64())],
            ["bucket", "chunk", "classes", "counts", "tokens", "distinct"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["bucket"] != rows[-1]["bucket"]:
                    yield done(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield done(rows)

    return run


def _matrix(contexts: DataFrame, classes: int) -> np.ndarray:
    m = np.zeros((classes + 1) ** 2)
    for r in contexts.where("ctx is not null").groupBy("ctx").agg(F.sum("times")).collect():  # at most (classes + 1)**2 rows
        m[r[0]] = r[1]
    return m.reshape(classes + 1, -1)


def _scores(m: np.ndarray, total: int, distinct: int, classes: int, share: float, buckets: int):
    logs, size = _logs(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches, buckets):
            ids, cls, before = _pairs(row, classes)
            counts = row["counts"][ids]
            base = (counts + 1) / (total + distinct + 1)
            by_class = np.where(counts > 0, np.exp(logs[before, cls]) * counts / size[cls], 0.0)
            starts = np.cumsum(row["sizes"]) - row["sizes"]
            held = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), np.log10(base), np.log10(share * by_class + (1 - share) * base))]
            yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(~row["train"]), pa.array(row["sizes"]), *map(pa.array, held)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, share: float = CLASS_SHARE) -> DataFrame:
    """Return per input row: doc_id, held_out (not ``train``), n_tokens, n_known,
    train_tokens, base_score and score (log10 probabilities of the text).

    * A-Z are lower-cased; a text's tokens are its words and one end
    * null and empty texts are the end token alone; a null ``train`` teaches nothing
    * repeated rows count as often as they occur; an empty table gives an empty result;
      other columns are ignored
    * rounds (at least 1) of exchange; the classes of the best one are used
    * the model is a mixture of the class bigram and the add-one unigram, so words that
      training never saw keep the unigram's probability
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    encoded = materialise(map_arrow(rows, _encode(classes), _ENCODED), "lm-encoded")
    entries = encoded.agg(F.coalesce(F.sum(F.length("h")), F.lit(0))).first()[0] // 8
    buckets = max(8, entries // BUCKET_WORDS)
    answers, best, tried = None, None, []
    for turn in range(rounds + 1):
        now = encoded.withColumn("answers", F.lit(None)) if answers is None else encoded.join(answers.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "classes", "counts")).alias("answers")), "chunk")
        asked = materialise(now.mapInArrow(_contexts(classes, buckets, turn < rounds), _ASKED), "lm-contexts")
        m = _matrix(asked, classes)
        # Words of different buckets move at the same time. If that made it worse, the
        # classes of the round before stay.
        if answers is not None and (best is None or objective(m) > best[0]):
            best = (objective(m), m, now, answers)
        if turn < rounds:
            dealt = asked.where("bucket is not null").drop("ctx", "times").repartition("bucket").sortWithinPartitions("bucket", "chunk")
            answers = materialise(map_arrow(dealt, _answers(m, classes), "bucket int, chunk string, classes binary, counts binary, tokens long, distinct long"), "lm-classes")
            tried.append(answers)
        discard(asked)
    _, m, now, answers = best
    discard(*[x for x in tried if x is not answers])
    total, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    scored = now.mapInArrow(_scores(m, total, distinct, classes, share, buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
