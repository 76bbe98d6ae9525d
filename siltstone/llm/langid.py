"""Language of texts by a linear-chain conditional random field over their words.

Every word gets a label. A word's score for a label is the sum of learned weights of its
byte n-grams (with marks at both ends, so that they include its affixes) and of its
entry in a lexicon; learned transitions join the labels of neighbours. Labels are read
off forward-backward marginals, so a text that switches language has several.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import discard, map_arrow, materialise
from siltstone.llm.textscan import Chunk, chunks, mix

#: Documents that the model is learned from, at most: by turns from each label, those with
#: the least hashes first. Their whole texts are used.
TRAINING_DOCS = 1500
#: Shards that learn side by side, rounds after which their weights are averaged, and
#: passes over the words of a shard in each round.
SHARDS, ROUNDS, EPOCHS = 8, 3, 5
#: Weights of n-grams, and of whole words (the lexicon); features share them by a hash.
BUCKETS, WORDS = 1 << 16, 1 << 17
ORDERS = (1, 2, 3, 4)
#: Words in a training segment, and segments in a step of a pass.
SEGMENT, STEP = 256, 256
#: Features whose weights are summed at a time, and that travel in one row.
BLOCK, ROWS = 1 << 18, 1 << 13
#: Bytes of a training text that are worked on at a time: longer ones are cut at a space.
PIECE = 1 << 20


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS + WORDS, labels)
    moves: np.ndarray  # log potentials, label before x label


def _features(c: Chunk, place: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of distinct words (given by the place of one token each): feature
    numbers, and the bounds of each word's."""
    start, size = c.start[place], c.end[place] - c.start[place]
    wide = size + 2
    first = np.cumsum(wide) - wide
    text = np.zeros(int(wide.sum()), np.uint64)
    inner = np.ones(len(text), bool)
    inner[first] = inner[first + wide - 1] = False
    offset = np.arange(len(text)) - np.repeat(first, wide) - 1
    text[inner] = c.data[(np.repeat(start, wide) + offset)[inner]]
    text[first], text[first + wide - 1] = 1, 2
    found, owners = [], []
    for n in ORDERS:
        many = np.maximum(wide - n + 1, 0)
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - first, many)
        rolled = np.full(len(at), n, np.uint64)
        for k in range(n):
            rolled = rolled * np.uint64(257) + text[at + k]
        found.append((mix(rolled) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(np.repeat(np.arange(len(size)), many))
    found.append(BUCKETS + (hashes % np.uint64(WORDS)).astype(np.int64))
    owners.append(np.arange(len(size)))
    flat, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def _emissions(weights: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the weights of each word's features, a block of words at a time. Every
    word has features, so that no sum is over an empty range."""
    out = np.zeros((len(bounds) - 1, weights.shape[1]), weights.dtype)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK, "right")) - 1)
        out[lo:hi] = np.add.reduceat(weights[flat[bounds[lo] : bounds[hi]]], bounds[lo:hi] - bounds[lo])
        lo = hi
    return out


def marginals(scores: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all sequences at once, the longest first: marginals of
    each word, and expected counts of transitions. first: bounds of the sequences."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t = np.exp(moves - moves.max())
    ahead, behind = np.empty_like(e), np.ones_like(e)
    a = None
    for k in range(longest):
        rows = start[: active[k]] + k
        a = e[rows] if a is None else (a[: active[k]] @ t) * e[rows]
        a /= a.sum(axis=1, keepdims=True)
        ahead[rows] = a
    expected = np.zeros_like(t)
    for k in range(longest - 1, 0, -1):
        rows = start[: active[k]] + k
        b = e[rows] * behind[rows]
        back = b @ t.T
        before = ahead[rows - 1]
        expected += ((before / (before * back).sum(axis=1, keepdims=True)).T @ b) * t
        behind[rows - 1] = back / back.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True), expected


@dataclass
class _Part:
    """Words of some training texts, joined and cut in segments."""

    flat: np.ndarray  # features of the distinct words
    bounds: np.ndarray  # of each distinct word's
    local: np.ndarray  # the distinct word of each word
    truth: np.ndarray  # its label
    first: np.ndarray  # bounds of the segments


def _cut(text: bytes) -> list[bytes]:
    """A text in pieces of at most ``PIECE`` bytes, between words where there is a space."""
    out, lo = [], 0
    while len(text) - lo > PIECE:
        hi = max(text.rfind(b" ", lo, lo + PIECE), text.rfind(b"\n", lo, lo + PIECE))
        hi = hi if hi > lo else lo + PIECE
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]]


def _parts(texts: list[bytes], truth: list[int]) -> list[_Part]:
    pieces = [(p, y) for t, y in zip(texts, truth, strict=True) for p in _cut(t)]
    labels, found = np.array([y for _, y in pieces]), []
    for lo, hi, c in chunks(pa.array([p for p, _ in pieces], pa.large_binary()), limit=PIECE):
        u, place, local = np.unique(c.hashes(), return_index=True, return_inverse=True)
        if len(u):
            flat, bounds = _features(c, place, u)
            found.append(_Part(flat.astype(np.int32), bounds, local.astype(np.int32), np.repeat(labels[lo:hi], np.diff(c.first)), np.append(np.arange(0, len(local), SEGMENT), len(local))))
    return found


def _descend(parts: list[_Part], model: Model, squares: tuple[np.ndarray, np.ndarray], *, epochs: int, rate: float = 0.3, decay: float = 1e-5) -> int:
    """Passes of gradient descent on the likelihood of the parts, in place: steps are
    scaled by the sums of squared gradients so far. Returns the number of words."""
    weights, moves, (wg, mg) = model.weights, model.moves, squares
    labels, total = len(model.labels), sum(len(p.local) for p in parts)
    seen = np.zeros_like(moves)
    for p in parts:
        inside = np.ones(len(p.local), bool)
        inside[p.first[:-1]] = False
        at = np.flatnonzero(inside)
        np.add.at(seen, (p.truth[at - 1], p.truth[at]), 1)
    for _ in range(epochs if total else 0):
        gradient, expected = np.zeros(weights.shape), np.zeros_like(moves)
        for p in parts:
            scores, words = _emissions(weights, p.flat, p.bounds), np.zeros((len(p.bounds) - 1, labels))
            for a in range(0, len(p.first) - 1, STEP):
                own = p.first[a : a + STEP + 1]
                mine = p.local[own[0] : own[-1]]
                q, e = marginals(scores[mine].astype(np.float64), moves, own - own[0])
                expected += e
                q[np.arange(len(q)), p.truth[own[0] : own[-1]]] -= 1
                for k in range(labels):
                    words[:, k] += np.bincount(mine, q[:, k], len(words))
            many = np.diff(p.bounds)
            for k in range(labels):
                gradient[:, k] += np.bincount(p.flat, np.repeat(words[:, k], many), len(weights))
        for x, g, s in ((weights, gradient, wg), (moves, expected - seen, mg)):
            g = g / total + decay * x
            s += g * g
            x -= (rate * g / np.sqrt(s)).astype(x.dtype)
    return total


def _empty(labels: list[str]) -> tuple[Model, tuple[np.ndarray, np.ndarray]]:
    model = Model(labels, np.zeros((BUCKETS + WORDS, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    return model, (np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6))


_LEARNED = "block int, words double, weights binary, squares binary"


def _shard(model: Model, squares: tuple[np.ndarray, np.ndarray], epochs: int, seed: int):
    """One shard's passes from the common weights: rows of blocks of weights and squares,
    times its words, with the transitions as block -1. Texts are joined in random order
    and cut in segments, so that some segments switch label."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        order = np.random.default_rng(seed).permutation(len(table))
        texts, langs = table.column("t").to_pylist(), table.column("l").to_pylist()
        own = Model(model.labels, model.weights.copy(), model.moves.copy())
        sums = squares[0].copy(), squares[1].copy()
        n = float(_descend(_parts([texts[i] for i in order], [model.labels.index(langs[i]) for i in order]), own, sums, epochs=epochs))
        rows = [(-1, own.moves, sums[1])] + [(i, own.weights[k : k + ROWS], sums[0][k : k + ROWS]) for i, k in enumerate(range(0, len(own.weights), ROWS))]
        packed = [[(x.astype(np.float64) * n).tobytes() for x in column] for column in list(zip(*rows, strict=True))[1:]]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "words": pa.array([n] * len(rows)), "weights": pa.array(packed[0], pa.binary()), "squares": pa.array(packed[1], pa.binary())})

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """The mean of a block over the shards, each by its words."""
    n = sum(table.column("words").to_pylist())
    mean = lambda name: (sum(np.frombuffer(x, np.float64) for x in sorted(table.column(name).to_pylist())) / max(n, 1.0)).tobytes()
    return pa.table({"block": table.column("block").slice(0, 1), "words": pa.array([n]), "weights": pa.array([mean("weights")], pa.binary()), "squares": pa.array([mean("squares")], pa.binary())})


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many documents each label gives if labels take turns until ``rows`` are taken."""
    found, left = dict.fromkeys(counts, 0), rows
    open_ = sorted(counts)
    while left > 0 and open_:
        share = max(1, left // len(open_))
        for k in open_[:left] if share == 1 else open_:
            more = min(share, counts[k] - found[k])
            found[k] += more
            left -= more
        open_ = [k for k in open_ if counts[k] > found[k]]
    return found


def training_set(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_DOCS) -> DataFrame:
    """h, l, t of the documents to learn from: of each label those with the least hashes.

    Labels are counted first; a threshold on the hash then leaves some more than twice
    what a label gives, which are ranked. So what is moved and ranked has the size of the
    result, however many documents or tasks there are. With more labels than ``rows``,
    those with the most documents are learned."""
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    known = docs.where(text.rlike(r"\p{L}") & F.col(lang_col).isNotNull()).select(F.xxhash64(F.col(id_col), text).alias("h"), F.col(lang_col).cast("string").alias("l"), text.cast("binary").alias("t"))
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "l").limit(rows).collect()}
    limits = [(k, q, min((1 << 63) - 1, int((2 * q + 50) / counts[k] * (1 << 64)) - (1 << 63))) for k, q in quotas(counts, rows).items()]
    # At most ``rows`` labels, with two numbers each.
    least = F.broadcast(spark.createDataFrame(limits, "l string, quota int, most long"))
    near = known.join(least, "l").where("h <= most").groupBy("h", "l", "quota").agg(F.any_value("t").alias("t"))
    turn = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    return near.withColumn("turn", turn).where("turn <= quota").select("h", "l", "t")


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_DOCS, shards: int = SHARDS, rounds: int = ROUNDS, epochs: int = EPOCHS, seed: int = 11) -> Model | None:
    """Learn from the whole texts of at most ``rows`` documents with a letter in the text
    and a label. None if there are none.

    The documents are dealt to shards by their hashes. In each round every shard goes on
    from the common weights, and the weights are averaged (iterative parameter mixing),
    so that texts stay with the tasks and the driver holds one set of weights."""
    taken = materialise(training_set(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, rows=rows), "langid-training")
    labels = sorted(r.l for r in taken.select("l").distinct().collect())
    if not labels:
        discard(taken)
        return None
    model, squares = _empty(labels)
    dealt = taken.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    for turn in range(rounds):
        parts = dealt.groupBy("shard").applyInArrow(_shard(model, squares, epochs, seed + turn), _LEARNED)
        for r in parts.groupBy("block").applyInArrow(_averaged, _LEARNED).toLocalIterator():
            at = slice(r.block * ROWS, (r.block + 1) * ROWS)
            for target, raw in zip((model.moves, squares[1]) if r.block < 0 else (model.weights[at], squares[0][at]), (r.weights, r.squares), strict=True):
                target[...] = np.frombuffer(raw, np.float64).reshape(target.shape)
    discard(taken)
    return model


_RUNS = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, c in chunks(batch.column(1)):
                u, place, local = np.unique(c.hashes(), return_index=True, return_inverse=True)
                n = hi - lo
                share, switches = np.zeros((n, len(model.labels))), np.zeros(n, np.int64)
                runs: list[list] = [[]] * n
                if len(u):
                    p, _ = marginals(_emissions(model.weights, *_features(c, place, u))[local].astype(np.float64), model.moves, c.first)
                    size = np.diff(c.first)
                    held = np.flatnonzero(size)
                    # Sums of each text alone, rounded: equal texts have equal scores.
                    share[held] = np.round(np.add.reduceat(p, c.first[held]) / size[held, None], 9)
                    best = p.argmax(axis=1)
                    new = np.zeros(len(best), bool)
                    new[1:] = best[1:] != best[:-1]
                    new[c.first[:-1][c.first[:-1] < len(new)]] = False
                    counts = np.concatenate([[0], np.cumsum(new)])
                    switches = counts[c.first[1:]] - counts[c.first[:-1]]
                    new[c.first[:-1][np.diff(c.first) > 0]] = True
                    at = np.flatnonzero(new)
                    said, many = np.array(model.labels, object)[best[at]], np.diff(np.append(at, len(best)))
                    spot = np.searchsorted(at, c.first)
                    runs = [[{"lang": x, "words": int(k)} for x, k in zip(said[a:b], many[a:b], strict=True)] for a, b in zip(spot[:-1], spot[1:], strict=True)]
                top = share.argmax(axis=1)
                lettered = np.array(batch.column(2).slice(lo, n).to_pylist(), bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.where(lettered, np.array(model.labels, object)[top], "und"), pa.string()), pa.array(np.where(lettered, np.clip(share[np.arange(n), top], 0, 1), 0.0)), pa.array(np.where(lettered, switches, 0)), pa.array([r if k else [] for r, k in zip(runs, lettered, strict=True)], _RUNS)],
                    ["doc_id", "lang_pred", "score", "n_switches", "runs"],
                )

    return run


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per input row: doc_id, lang_pred, score (mean marginal of that label over
    the text's words), n_switches (neighbours whose most probable labels differ), runs
    (the labels of the words in order: lang and number of words of each run).

    * null texts, empty texts and texts without a letter are ``und`` with score 0, and
      so is every text if there was nothing to learn from
    * ties go to the label first in order; repeated rows get the same results; an empty
      table gives an empty result; other columns are ignored
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_switches"), F.expr("cast(array() as array<struct<lang:string,words:bigint>>)").alias("runs"))
    return map_arrow(rows, _predict(model), "doc_id long, lang_pred string, score double, n_switches long, runs array<struct<lang:string,words:bigint>>")


def held_out(id_col: str = "doc_id", parts: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == 0
