"""Personal data: base patterns, wide candidates, and boosted trees that judge them.

Extraction, features, the trees and the redaction are DataFrame functions. The driver
only fits the trees, on the features of a bounded sample of candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents whose candidates the trees are fitted on, at most (least hashes of ids).
TRAINING_DOCS = 4_000
#: Kinds in the order of the results.
KINDS = ("email", "ip", "card", "phone")
#: Candidates of a document that are learned from, at most (those with the least hashes).
PER_DOC = 64
#: Probability of being right, as calibrated on held-out candidates, that a span must have.
PRECISION = 0.98

# Four code points that are never assigned characters. They are taken out of the text
# (one for one) before they mark something in it. No pattern matches them otherwise.
_CUT, _OTHER, _JOIN, _DOT = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

_LOCAL = f"A-Za-z0-9._%+{_DOT}-"
# The patterns are the base ones. Marks stand in for the separators that repeated groups
# would match, and look-behinds stop searches inside a run that has failed from its
# start; both keep the time linear in the length of the text.
_EMAIL = f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]+"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}"
_CARD = f"[0-9][0-9{_JOIN}]+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Generators of candidates: they would rather find too much.
_NUMBERS = r"(?<![0-9A-Za-z])[+(]?[0-9][0-9\x20()./-]{5,}[0-9]"
_MAILS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++){1,6}"
# What a run is cut into: numbers before a digit or bracket that follows a space or
# bracket, mail addresses before each label of the domain.
_BETWEEN = r"(?<=[\x20)])(?=\(?[0-9])|(?<=[(0-9./-])(?=\([0-9])"
_MAIL_HEAD = r"^[A-Za-z0-9._%+-]++\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]++"
_MAIL_LABEL = r"\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++"
#: Neighbouring pieces of a number that are judged together, at most; the longest
#: written forms (a country code and groups of two digits) have eight.
PIECES = 8
_HINTS = r"(?i)(?:phone|call|tel|fax|mobile|contact|mail|card|account)\W{0,6}\z"


#: A text is worked on in segments of at least so many code points: what is done for each
#: span (positions, overlaps, redaction) then costs no more in a long text.
SEGMENT = 4_096
# Where segments may end: no pattern matches across these places.
_EDGE = r"(?<=[^A-Za-z0-9._%+@()\[\]/\x20-])|(?<=[A-Za-z]\x20)(?=[A-Za-z])|(?<=\x20)(?=\+)"
#: Parts whose lengths are summed together; their sums are summed after that.
_BLOCK = 512
_SPAN = "array<struct<start:bigint,end:bigint,s:string,gap:string,next:string>>"


def _let(x: Column, use: Callable) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _ends(parts: Column) -> Column:
    """0, then where each string of a column of arrays that aren't empty ends."""
    summed = lambda xs, of: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda e, x: F.concat(e, F.array(F.element_at(e, -1) + of(x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int")), lambda b: summed(F.slice(parts, b * _BLOCK + 1, _BLOCK), F.length))
    moved = lambda bs: F.zip_with(bs, F.slice(summed(bs, lambda b: F.element_at(b, -1)), 1, F.size(bs)), lambda b, at: F.transform(F.slice(b, 2, _BLOCK), lambda x: x + at))
    return F.concat(F.array(F.lit(0).cast("long")), F.flatten(_let(blocks, moved)))


def _found(text: Column, pattern: str) -> Column:
    """Leftmost matches as array of (start, end, s: what matched, gap: the last 24 code
    points between it and the match before it, next: the code point after it)."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT)

    def spans(p: Column) -> Column:
        odd = F.sequence(F.lit(1), F.size(p) - 1, F.lit(2))
        one = lambda e: lambda i: F.struct(F.get(e, i).alias("start"), F.get(e, i + 1).alias("end"), F.get(p, i).alias("s"), F.right(F.get(p, i - 1), F.lit(24)).alias("gap"), F.left(F.get(p, i + 1), F.lit(1)).alias("next"))
        return F.when(F.size(p) > 1, _let(_ends(p), lambda e: F.transform(odd, one(e)))).otherwise(F.expr("array()").cast(_SPAN))

    return _let(parts, spans)


def _segments(text: Column, least: int) -> Column:
    """A text as array of (at: where it starts, before: the last 24 code points of the
    one before it, text, digits: whether it has any)."""
    cut = F.split(F.regexp_replace(text, f"(?s)\\G(?:.{{{least},}}?(?:{_EDGE})|.+\\z)", f"$0{_CUT}"), _CUT)

    def made(p: Column) -> Column:
        one = lambda e: lambda x, i: F.struct(F.get(e, i).alias("at"), F.coalesce(F.right(F.get(p, i - 1), F.lit(24)), F.lit("")).alias("before"), x.alias("text"), x.rlike("[0-9]").alias("digits"))
        return _let(_ends(p), lambda e: F.transform(p, one(e)))

    return F.filter(_let(cut, made), lambda g: g.text != "")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def worth(i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """doc_id, text, and its segments (at, before, text, digits, per kind an array of
    spans, base: those of all kinds). Spans count from the start of their segment."""
    t = F.translate(F.coalesce(F.col(text_col), F.lit("")), _CUT + _OTHER + _JOIN + _DOT, "\ufffd" * 4)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text"))
    none = F.expr("array()").cast(_SPAN)
    octets = f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"

    def searched(g: Column) -> Column:
        dotted = F.regexp_replace(g.text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
        joined = F.regexp_replace(g.text, r"(?<=[0-9])[\x20-](?=[0-9])", _JOIN)
        email = F.when(F.contains(g.text, F.lit("@")), _found(dotted, _EMAIL)).otherwise(none)
        ip = F.filter(F.when(g.digits, _found(g.text, _IP)).otherwise(none), lambda s: s.s.rlike(octets))
        card = F.filter(F.when(g.digits, _found(joined, _CARD)).otherwise(none), lambda s: F.when(F.length(_digits(s.s)).between(13, 19), _luhn(_digits(s.s))).otherwise(F.lit(False)))
        phone = F.filter(F.when(F.contains(g.text, F.lit("+")), _found(g.text, _PHONE)).otherwise(none), lambda s: F.length(_digits(s.s)).between(9, 15))
        return F.struct(g.at.alias("at"), g.before.alias("before"), g.text.alias("text"), g.digits.alias("digits"), email.alias("email"), ip.alias("ip"), card.alias("card"), phone.alias("phone"))

    def joined(g: Column) -> Column:
        return g.withField("base", F.concat(*[g[kind] for kind in KINDS]))

    return rows.withColumn("segments", F.transform(F.transform(_segments(F.col("text"), segment), searched), joined))


FEATURES = ["n_digits", "length", "groups", "parens", "dashes", "dots", "slashes", "spaces", "longest", "hinted", "letter_next", "mail"]


def _pieces(run: Column, mail: Column) -> Column:
    """A run in pieces, whole when joined: numbers are cut at spaces and brackets, mail
    before each label after the first."""
    head = F.regexp_extract(run, _MAIL_HEAD, 0)
    labels = F.regexp_extract_all(F.substring(run, F.length(head) + 1, F.length(run)), F.lit(_MAIL_LABEL), F.lit(0))
    heads = F.array(F.concat(head, F.coalesce(F.get(labels, F.lit(0)), F.lit(""))))
    return F.when(mail == 1, F.concat(heads, F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))))).otherwise(F.split(run, _BETWEEN, -1))


def candidates(spans: DataFrame) -> DataFrame:
    """Add cands, to the segments and, counted from the start of the text, to the rows:
    array of (start, end, kind number, known (overlaps a base span), right (is a base
    span, or a base phone number without its country code), features): runs that the
    generators find, and neighbouring pieces of them, up to PIECES of a number and from
    the start of a mail address."""
    none = F.expr("array()").cast(_SPAN)
    count = lambda s, p: F.length(F.regexp_replace(s, f"[^{p}]", ""))

    def run(g: Column, mail: int) -> Callable:
        def made(s: Column) -> Column:
            around = F.when(F.length(s.gap) == s.start, F.concat(g.before, s.gap)).otherwise(s.gap)
            return F.struct(s.start.alias("start"), F.lit(mail).alias("mail"), _pieces(s.s, F.lit(mail)).alias("p"), around.rlike(_HINTS).alias("hinted"), s.next.rlike("[A-Za-z]").alias("next"))

        return made

    def runs(g: Column) -> Column:
        return F.concat(
            F.transform(F.when(g.digits, _found(g.text, _NUMBERS)).otherwise(none), run(g, 0)),
            F.transform(F.when(g.text.rlike(r"@|[\[(]at[\])]"), _found(g.text, _MAILS)).otherwise(none), run(g, 1)),
        )

    def parts(r: Column) -> Column:
        """(start, mail, s, hinted, next, whole, second) of the run and of its neighbouring pieces."""
        return _let(_ends(r.p), lambda ends: parts_at(r, ends))

    def parts_at(r: Column, ends: Column) -> Column:
        n = F.size(r.p)

        def part(i: Column, k: Column) -> Column:
            joined = F.array_join(F.slice(r.p, i + 1, k), "")
            s = F.when(r.mail == 1, joined).otherwise(F.regexp_replace(joined, r"[^0-9]+\z", ""))
            # A bracket that isn't closed within the part does not belong to it.
            bare = (r.mail == 0) & (k < n) & s.startswith("(") & ~F.contains(s, F.lit(")"))
            return F.struct(
                (r.start + F.get(ends, i) + bare.cast("long")).alias("start"), r.mail.alias("mail"), F.when(bare, F.substring(s, F.lit(2), F.length(s))).otherwise(s).alias("s"),
                ((i == 0) & r.hinted).alias("hinted"), ((i + k == n) & r.next).alias("next"), (k == n).alias("whole"), (i == 1).alias("second"),
            )

        # Only a run's first piece can have a hint before it: digits end the hint.
        first = F.when(r.mail == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1))
        most = F.when(r.mail == 1, n).otherwise(F.least(n, F.lit(PIECES)))
        some = F.flatten(F.transform(first, lambda i: F.transform(F.sequence(F.lit(1), F.least(most, n - i)), lambda k: part(i, k))))
        every = F.when(most < n, F.concat(some, F.array(part(F.lit(0), n)))).otherwise(some)
        paired = lambda c: count(c.s, "(") == count(c.s, ")")
        return F.filter(every, lambda c: c.whole | (c.mail == 1) | ((F.length(c.s) >= 7) & paired(c)))

    def judged(g: Column, c: Column) -> Column:
        s, end = c.s, c.start + F.length(c.s)
        groups = F.split(s, "[^0-9]+")
        digits = _digits(s)
        values = [F.length(digits), F.length(s), F.size(F.filter(groups, lambda g: g != "")), count(s, "()"), count(s, "\\-"), count(s, "."), count(s, "/"), count(s, " "), F.array_max(F.transform(groups, F.length)), c.hinted, c.next, c.mail]
        card = F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
        # Both begin and end with a digit, but for a plus sign or bracket before it.
        same = lambda b: (b.end == end) & ((b.start == c.start) | ((b.start == c.start + 1) & s.rlike("^[^0-9]")))
        right = F.exists(g.base, lambda b: F.when(c.mail == 1, (c.start <= b.start) & (b.end <= end)).otherwise(same(b)))
        # So is the number within a country that follows the country code of one.
        right = right | F.exists(g.phone, lambda b: c.second & (b.end == end) & (c.start - b.start).between(2, 5))
        known = F.exists(g.base, lambda b: (b.start < end) & (c.start < b.end))
        return F.struct(c.start.alias("start"), end.alias("end"), F.when(c.mail == 1, 0).when(card, 2).otherwise(3).alias("k"), known.alias("known"), right.alias("right"), F.array(*[v.cast("double") for v in values]).alias("x"))

    found = F.transform("segments", lambda g: g.withField("cands", F.transform(F.flatten(F.transform(runs(g), parts)), lambda c: judged(g, c))))
    return spans.withColumn("segments", found).withColumn("cands", _in_text(lambda g: g.cands))


def _in_text(spans: Callable) -> Column:
    """Spans of all segments, counted from the start of the text."""
    return F.flatten(F.transform("segments", lambda g: F.transform(spans(g), lambda s: s.withField("start", s.start + g.at).withField("end", s.end + g.at))))


@dataclass(frozen=True)
class Boosted:
    """Trees (feature, cut, (feature, cut, leaf, leaf), (feature, cut, leaf, leaf)),
    summed from ``bias``; spans from their kind's threshold up are redacted. ``held`` has
    for each kind how many held-out candidates reached it, and how many of them are
    right."""

    bias: float = 0.0
    trees: tuple = ()
    thresholds: tuple[float, ...] = (float("inf"),) * len(KINDS)
    held: tuple[tuple[int, int], ...] = ((0, 0),) * len(KINDS)

    def column(self, x: Column) -> Column:
        def at(t: tuple) -> Column:
            return F.when(F.get(x, F.lit(t[0])) <= t[1], F.lit(t[2])).otherwise(F.lit(t[3]))

        total = F.lit(self.bias)
        for f, cut, low, high in self.trees:
            total = total + F.when(F.get(x, F.lit(f)) <= cut, at(low)).otherwise(at(high))
        return total


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int = 5) -> tuple[int, float]:
    """The feature and cut of the largest gain with ``least`` candidates on either side,
    so that no tree follows single ones (what is personal but no base span is among the
    wrong ones too)."""
    best = (-1.0, 0, float(x[:, 0].max()) if len(x) else 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            a, b = np.cumsum(g[order])[cut], np.cumsum(h[order])[cut]
            gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best[1], best[2]


def isotonic(score: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The probability of being right at each score: the rising step function that is
    nearest to the outcomes (neighbours that fall are pooled)."""
    order = np.argsort(score, kind="stable")
    u, first, many = np.unique(score[order], return_index=True, return_counts=True)
    pools: list[list[float]] = []  # right, all, scores
    for n, k in zip(np.add.reduceat(right[order].astype(float), first) if len(u) else [], many, strict=True):
        pools.append([float(n), float(k), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            n, k, c = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + k, pools[-1][2] + c]
    steps = np.repeat([n / k for n, k, _ in pools], [int(c) for *_, c in pools])
    return steps[np.searchsorted(u, score)] if len(u) else np.zeros(0)


def _threshold(score: np.ndarray, right: np.ndarray, precision: float, least: int = 5) -> float:
    """The least score with the probability ``precision``; none if fewer than ``least``
    candidates reach it."""
    good = score[isotonic(score, right) >= precision]
    return float(good.min()) - 1e-9 if len(good) >= least else float("inf")


def boost(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, *, trees: int = 20, rate: float = 0.4, precision: float = PRECISION, seed: int = 5) -> Boosted:
    """Logistic boosting of trees of depth two. Scores are calibrated on held-out
    candidates (a third) of each kind by itself; a kind's threshold is the least score
    whose probability is ``precision``. Nothing to learn from: nothing is added."""
    third = np.random.default_rng(seed).permutation(len(y)) % 3 == 0
    if y[~third].sum() < 5 or third.sum() < 5:
        return Boosted()
    a, b = x[~third], y[~third].astype(float)
    bias = float(np.log((b.sum() + 1) / (len(b) - b.sum() + 1)))
    score, held, out = np.full(len(b), bias), np.full(int(third.sum()), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = b - p, p * (1 - p)
        f, cut = _split(a, g, h)
        tree = [f, cut]
        for low in (True, False):
            m = (a[:, f] <= cut) == low
            f2, cut2 = _split(a[m], g[m], h[m])
            k = m & (a[:, f2] <= cut2)
            leaves = [rate * float(g[z].sum() / (h[z].sum() + 1)) for z in (k, m & ~k)]
            tree.append((f2, cut2, *leaves))
            score[k] += leaves[0]
            score[m & ~k] += leaves[1]
            m = (x[third][:, f] <= cut) == low
            held[m] += np.where(x[third][m, f2] <= cut2, leaves[0], leaves[1])
        out.append(tuple(tree))
    own = [(held[kinds[third] == k], y[third][kinds[third] == k]) for k in range(len(KINDS))]
    thresholds = tuple(_threshold(*one, precision) for one in own)
    return Boosted(bias, tuple(out), thresholds, tuple((int((h >= t).sum()), int(r[h >= t].sum())) for (h, r), t in zip(own, thresholds, strict=True)))


def training_texts(docs: DataFrame, *, rows: int = TRAINING_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h, text of at most ``rows`` different documents with a digit or an @: those with
    the least hashes of id and text. The hashes are chosen first, and only the texts of
    the chosen move."""
    held = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    least = held.groupBy("h").agg(F.lit(1)).select("h").orderBy("h").limit(rows)
    return held.join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.any_value("text").alias("text"))


def fit(docs: DataFrame, *, rows: int = TRAINING_DOCS, per_doc: int = PER_DOC, id_col: str = "doc_id", text_col: str = "text", **options) -> Boosted:
    """Fit on at most ``per_doc`` candidates of each of at most ``rows`` documents: so
    many rows of numbers reach the driver. A candidate that is a base span (or a phone
    number less its code) is right, and one that overlaps a base span otherwise teaches
    nothing. Features do not show what the base patterns ask for (a plus sign, a
    checksum), so what else looks like a right one is found too."""
    few = training_texts(docs, rows=rows, id_col=id_col, text_col=text_col)
    found = candidates(base_spans(few, id_col="h")).select("doc_id", F.filter("cands", lambda c: c.right | ~c.known).alias("c"))
    some = F.slice(F.array_sort(F.transform("c", lambda c: F.struct(F.xxhash64("doc_id", c.start, c.end, c.k).alias("u"), c.x.alias("x"), c.right.alias("right"), c.k.alias("k")))), 1, per_doc)
    taken = found.select("doc_id", F.explode(some).alias("c")).orderBy("doc_id", "c").select("c.x", "c.right", "c.k").collect()
    return boost(np.array([r.x for r in taken], float).reshape(-1, len(FEATURES)), np.array([r.right for r in taken], bool), np.array([r.k for r in taken], int), **options)


def find_pii(docs: DataFrame, model: Boosted, *, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Return per input row: doc_id, text, base and spans (arrays of (kind number, start,
    end, kind) in the order of kinds, then start), and segments (at, text, base and spans
    counted from the start of the segment). Results do not depend on ``segment``.

    * null and empty texts have no spans; texts of any length are searched whole
    * base spans of different kinds may overlap; added ones overlap no base span and no
      other added one: of those that overlap, that with the best score is taken, then
      one with at most 15 digits, then the longest, then the first
    * repeated rows get the same results; an empty table gives an empty result; other
      columns are ignored
    """
    judged = candidates(base_spans(docs, id_col=id_col, text_col=text_col, segment=segment))
    kind = "array<struct<k:int,start:bigint,end:bigint,kind:string>>"

    def named(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(k).alias("k"), s.start.alias("start"), s.end.alias("end"), F.lit(KINDS[k]).alias("kind")))

    def added(g: Column) -> Column:
        if not np.isfinite(model.thresholds).any():
            return F.expr("array()").cast(kind)
        scored = F.transform(F.filter(g.cands, lambda c: ~c.known), lambda c: F.struct((-model.column(c.x)).alias("score"), (F.get(c.x, F.lit(0)) > 15).alias("long"), (c.start - c.end).alias("size"), c.start.alias("start"), c.end.alias("end"), c.k.alias("k")))
        least = lambda k: F.element_at(F.array(*[F.lit(float(t)) for t in model.thresholds]), k + 1)
        best = F.array_sort(F.filter(scored, lambda c: c.score <= -least(c.k)))
        return F.aggregate(
            best, F.expr("array()").cast(kind),
            lambda t, c: F.when(F.exists(t, lambda o: (o.start < c.end) & (c.start < o.end)), t).otherwise(F.concat(t, F.array(F.struct(c.k.alias("k"), c.start.alias("start"), c.end.alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), c.k + 1).alias("kind"))).cast(kind))),
        )

    def taken(g: Column) -> Column:
        base = F.concat(*[named(k, g[name]) for k, name in enumerate(KINDS)])
        return F.struct(g.at.alias("at"), g.text.alias("text"), base.alias("base"), F.concat(base, added(g)).alias("spans"))

    segments = F.transform("segments", taken)
    found = judged.select("doc_id", "text", segments.alias("segments"))
    return found.select("doc_id", "text", F.sort_array(_in_text(lambda g: g.base)).alias("base"), F.sort_array(_in_text(lambda g: g.spans)).alias("spans"), "segments")


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text, each run of overlapping spans replaced by [KIND] of its first."""

    def piece(g: Column) -> Column:
        order = F.sort_array(F.transform(g.spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
        walked = F.aggregate(
            order, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("t")),
            lambda a, s: F.when(s.start >= a.at, F.struct(s.end.alias("at"), F.concat(a.t, F.substring(g.text, (a.at + 1).cast("int"), (s.start - a.at).cast("int")), F.lit("["), F.upper(s.kind), F.lit("]")).alias("t"))).otherwise(F.struct(F.greatest(a.at, s.end).alias("at"), a.t.alias("t"))),
            lambda a: F.concat(a.t, F.substring(g.text, (a.at + 1).cast("int"), F.length(g.text))),
        )
        return walked

    return found.select("doc_id", F.array_join(F.transform("segments", piece), "").alias("text"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
