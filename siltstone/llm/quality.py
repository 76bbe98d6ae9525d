"""Quality rules: a decision list learned by sequential covering.

Statistics of each text are computed in vectorised passes. A list of rules, each a
conjunction of thresholds, is grown and pruned one rule at a time on labelled
statistics, and becomes one Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import carried, map_arrow
from siltstone.llm.textscan import Chunk, chunks, counts_in_groups, mix

#: Labelled rows that the rules are learned from, at most (by the order of a hash).
TRAINING_ROWS = 20_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?\"'()-")] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_digits", "n_marks", "n_bangs", "n_lines", "n_echoes"]
#: What rules test. Ratios whose expectation does not move with the length of a text,
#: so that a rule says the same of short and long texts. (The share of distinct words
#: is not one of them: it falls in any text as it gets longer.)
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_per_char": ("n_upper", "word_chars"), "digits_per_char": ("n_digits", "word_chars"), "marks_per_word": ("n_marks", "n_words"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "echo_share": ("n_echoes", "n_words"),
}


def _echoes(c: Chunk, h: np.ndarray) -> np.ndarray:
    """Words of each text that equal the word before them."""
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[c.first[:-1][c.first[:-1] < len(h)]] = False
    sums = np.concatenate([[0], np.cumsum(same)])
    return sums[c.first[1:]] - sums[c.first[:-1]]


def _repeats(c: Chunk, h: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each text in windows of ``width`` words found at least twice in it."""
    n = np.diff(c.first)
    windows = np.maximum(n - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(windows)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - c.first[:-1], windows)
    rolled = np.zeros(len(at), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0xC6BC279692B5C323) + h[at + k]
    times, _ = counts_in_groups(mix(rolled), first)
    step = np.zeros(len(h) + 1, np.int64)
    hit = at[times > 1]
    step[: len(h)] += np.bincount(hit, minlength=len(h))[: len(h)] if len(h) else 0
    ends = np.bincount(hit + width, minlength=len(h) + 1)
    step -= ends[: len(h) + 1]
    covered = np.cumsum(step)[:-1] > 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    return sums[c.first[1:]] - sums[c.first[:-1]]


def _lines(c: Chunk) -> tuple[list[int], list[int]]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    dup, lines = [], []
    raw = c.raw.tobytes()
    for a, b in zip(c.bounds[:-1], c.bounds[1:], strict=True):
        held = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        lines.append(len(held))
        dup.append(len(held) - len(set(held)))
    return dup, lines


def _statistics(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [k for k in range(batch.num_columns) if k > 1 or k == 1 and with_text]
            for lo, hi, c in chunks(batch.column(1), lower=False):
                h = c.hashes()
                repeat = _repeats(c, h)
                dup, lines = _lines(c)
                found = {
                    "n_words": np.diff(c.first), "word_chars": c.total(c.word & ((c.raw & 0xC0) != 0x80)), "n_symbols": c.total(_SYMBOL[c.raw]), "n_dup_lines": dup, "n_repeat_words": repeat,
                    "n_upper": c.total(_UPPER[c.raw]), "n_digits": c.total(_DIGIT[c.raw]), "n_marks": c.total(_MARK[c.raw]), "n_bangs": c.total(_BANG[c.raw]), "n_lines": lines, "n_echoes": _echoes(c, h),
                }
                counts = [pa.array(np.asarray(found[k]), pa.int64()) for k in COUNTS + MORE]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *counts, *[batch.column(k).slice(lo, hi - lo) for k in rest]], ["doc_id", *COUNTS, *MORE, *[batch.schema.names[k] for k in rest]])

    return run


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Return doc_id, the counts in COUNTS and MORE and the columns in ``carry`` (of which
    the text can be one) for every row. Null text has no words; other columns are ignored."""
    with_text, others = text_col in carry, tuple(c for c in carry if c != text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *others)
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS + MORE) + (", text string" if with_text else "") + carried(docs, others)
    found = map_arrow(rows, _statistics(with_text), schema)
    return found.withColumnRenamed("text", text_col) if with_text else found


def feature(name: str) -> Column:
    above, below = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below)), F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, at least?, threshold) hold: the text is poor."""

    conditions: tuple[tuple[str, bool, float], ...]

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        found = np.ones(len(next(iter(x.values()))), bool)
        for name, least, t in self.conditions:
            found &= x[name] >= t if least else x[name] <= t
        return found

    def column(self) -> Column:
        found = F.lit(True)
        for name, least, t in self.conditions:
            found = found & (feature(name) >= t if least else feature(name) <= t)
        return found


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """FOIL's gain of narrowing (p0, n0) to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> list[tuple[str, bool, float]]:
    held, inside = [], np.ones(len(y), bool)
    while len(held) < most and (inside & ~y).any():
        best = (0.0, None)
        p0, n0 = int((inside & y).sum()), int((inside & ~y).sum())
        if not p0:
            break
        for name in x:
            v, t = x[name][inside], y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            below_p = np.cumsum(t)[cut - 1]
            below_n = cut - below_p
            middle = (v[cut] + v[cut - 1]) / 2
            for least, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                g = _gain(p, n, p0, n0)
                i = int(np.argmax(g))
                if g[i] > best[0] + 1e-9:
                    best = (float(g[i]), (name, least, float(middle[i])))
        if best[1] is None:
            break
        name, least, t = best[1]
        held = [c for c in held if c[:2] != (name, least)] + [best[1]]  # the narrower one holds
        inside &= x[name] >= t if least else x[name] <= t
    return held


def learn_rules(x: dict[str, np.ndarray], poor: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 3, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest
    by the share (p - n) / (p + n), keep it if its precision there stands, take out the
    rows it covers, and go on. No labelled rows, or none that are poor: no rules."""
    third = np.random.default_rng(seed).permutation(len(poor)) % 3
    left, rules = np.ones(len(poor), bool), []
    while len(rules) < max_rules:
        grow, prune = left & (third > 0), left & (third == 0)
        if (grow & poor).sum() < min_covered:
            break
        conditions = _grow({k: v[grow] for k, v in x.items()}, poor[grow], max_conditions)
        if not conditions:
            break
        held = {k: v[prune] for k, v in x.items()}

        def worth(c: list, held: dict = held, y: np.ndarray = poor[prune]) -> tuple[float, int]:
            m = Rule(tuple(c)).matches(held)
            p, n = int((m & y).sum()), int((m & ~y).sum())
            return ((p - n) / (p + n) if p + n else -1.0), -len(c)

        rule = Rule(tuple(max((conditions[:k] for k in range(1, len(conditions) + 1)), key=worth)))
        m = rule.matches(x) & left
        if (m & poor).sum() < min_covered or (m & poor).sum() < min_precision * m.sum() or worth(list(rule.conditions))[0] < 2 * min_precision - 1:
            break
        rules.append(rule)
        left &= ~m
    return rules


def base_failed() -> Column:
    """Fewer than 10 words, or more than a fifth of them in repeated 5-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = TRAINING_ROWS, base_too: bool = True, **options) -> list[Rule]:
    """Learn rules from at most ``rows`` labelled ids, those with the least hashes. Rows
    with a null id, text or label teach nothing; without ``base_too``, nor do those that
    the base rules reject anyway. Of several labels of an id the worst counts, and of
    several documents of an id the one with the least counts. The chosen labels are sent
    to all workers: two numbers each."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(taken), "doc_id", "left_semi")
    counts = statistics(texts).where(F.lit(base_too) | ~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*COUNTS, *MORE)).alias("c")).select("doc_id", "c.*")
    found = counts.join(F.broadcast(taken), "doc_id").select(*[feature(k).alias(k) for k in FEATURES], (F.col("y") == 0).alias("poor"), "doc_id").orderBy("doc_id").toPandas()
    return learn_rules({k: found[k].to_numpy(float) for k in FEATURES}, found["poor"].to_numpy(bool), **options)


def decision(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds,
    or 0 if none does."""
    found = None
    for i, rule in enumerate(rules, 1):
        found = F.when(rule.column(), i) if found is None else found.when(rule.column(), i)
    return F.lit(0) if found is None else found.otherwise(0)


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add base_failed, rule and kept to a table of statistics."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
