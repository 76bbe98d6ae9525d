"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``window`` consecutive words, the least hash of their ``gram``-word grams is
kept: a fingerprint. Whatever stretch of ``window`` words a text and a benchmark item
share, both keep the same fingerprint of it, so that looking up fingerprints misses no
shared stretch. What meets is compared word by word (by a 128-bit digest of the
window), and neighbouring windows that agree are one longer hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import discard, materialise

#: What separates words, after A-Z have become a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window and of a gram.
WINDOW, GRAM = 10, 5
#: Windows of the benchmark whose fingerprints are sent to all tasks: some 60 MB. With
#: more, texts' fingerprints are shuffled to them.
SENT = 1 << 20


def words(text: Column) -> Column:
    """Words by splitting; a null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words").cast("long"))


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _gram(at: Column, size: int) -> Column:
    """Hash of ``size`` words from a place on: their hashes, each rotated by its rank."""
    return reduce(lambda a, b: a.bitwiseXOR(b), [_rotated(F.get("h", at + j), j) for j in range(size)])


def _fingerprint(at: Column, size: int, window: int, gram: int) -> Column:
    """Of a window of ``size`` words: the least hash of its grams, or, for the window of
    an item that is shorter than a window, the hash of all its words."""
    if size < window:
        return _gram(at, size).bitwiseXOR(F.xxhash64(F.lit(size)))
    grams = [_gram(at + j, gram) for j in range(window - gram + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def _digest(at: Column, size: Column) -> Column:
    return F.md5(F.array_join(F.slice("words", (at + 1).cast("int"), size.cast("int")), " "))


def item_windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item, size, fingerprint, digest of every window of every item. An item of fewer
    words than a window, but not none, is one window."""
    rows = _hashed(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words"))).where("n_words > 0")
    size = F.least(F.col("n_words"), F.lit(window)).cast("int")
    each = rows.select("item", "words", "h", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("n_words").cast("int") - size)).alias("at"))
    found = reduce(lambda held, m: held.when(F.col("size") == m, _fingerprint(F.col("at"), m, window, gram)), range(1, window), F.when(F.col("size") == window, _fingerprint(F.col("at"), window, window, gram)))
    return each.select("item", "size", found.alias("fingerprint"), _digest(F.col("at"), F.col("size")).alias("digest"))


def _windows(rows: DataFrame, short: list[int], window: int, gram: int) -> DataFrame:
    """row, doc_id, n_words, words, at, size, fingerprint of each window of each text,
    and one row with at = -1 for the text itself."""
    at, n = F.col("at"), F.col("n_words")
    last = n.cast("int") - min([window, *short])
    each = rows.select("row", "doc_id", "n_words", "words", "h", F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))).alias("at"))
    own = _fingerprint(at, window, window, gram)
    if not short:
        return each.select("row", "doc_id", "n_words", "words", "at", F.lit(window).alias("size"), own.alias("fingerprint"))
    fits = lambda m: (at >= 0) & (at + m <= n)
    kinds = [F.struct(F.lit(window).alias("size"), F.when(fits(window), own).alias("fingerprint"))]
    kinds += [F.struct(F.lit(m).alias("size"), F.when(fits(m), _fingerprint(at, m, window, gram)).alias("fingerprint")) for m in short]
    each = each.select("row", "doc_id", "n_words", "words", "at", F.explode(F.array(*kinds)).alias("w"))
    return each.select("row", "doc_id", "n_words", "words", "at", "w.size", "w.fingerprint").where((F.col("at") == -1) & (F.col("size") == window) | F.col("fingerprint").isNotNull())


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, sent: int = SENT) -> DataFrame:
    """Return per input row: doc_id, n_words, n_hit (words inside a window of an item
    that occurs in the text), n_spans (runs of such words), n_items (items with such
    windows), items_sha256 (of their ids, sorted as strings, joined by commas),
    contaminated.

    * null and empty texts have no words; a text shorter than a window can still hold
      an item that is as short
    * repeated rows and null or repeated doc ids are texts of their own; items with one
      id count as one item, and a null item id counts as an empty one
    * items without words are not looked for; without any items nothing is hit
    * an empty table gives an empty result; other columns are ignored

    A text's words are read by one task, its windows as a stream of rows. Only the
    distinct fingerprints and digests of the benchmark are sent to all tasks, and only
    if its windows, which are counted first, are at most ``sent``.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram has at least one word and at most as many as a window")
    held = materialise(item_windows(items, id_col=item_col, text_col=item_text_col, window=window, gram=gram), "winnow-items")
    sizes = {r[0]: r[1] for r in held.groupBy("size").agg(F.count(F.lit(1))).collect()}  # one row for each size
    few = sum(sizes.values()) <= sent
    ahead = F.broadcast if few else lambda df: df
    rows = _hashed(docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words")).withColumn("row", F.monotonically_increasing_id()))
    each = _windows(rows, sorted(set(sizes) - {window}), window, gram)
    prints, digests = held.select("fingerprint").distinct(), held.select("digest").distinct()
    digest = F.when(F.col("at") >= 0, _digest(F.col("at"), F.col("size"))).alias("digest")
    columns = ["row", "doc_id", "n_words", "at", "size"]
    if few:
        # The texts' own rows and the windows with a known fingerprint go on.
        known = each.join(F.broadcast(prints.withColumn("known", F.lit(True))), "fingerprint", "left").where("known or at = -1")
        met = materialise(known.select(*columns, digest), "winnow-met")
        pairs = met.where("at >= 0")
    else:
        met = materialise(each.select(*columns, "fingerprint", digest), "winnow-met")
        pairs = met.where("at >= 0").join(prints, "fingerprint", "left_semi").select(*columns, "digest")
    hits = materialise(pairs.join(ahead(digests), "digest", "left_semi").select("row", "at", "size", "digest"), "winnow-hits")
    # Windows in order: what each adds to the ones before it.
    order = Window.partitionBy("row").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = (F.col("at") + F.col("size")).cast("long")
    spans = hits.select("row", "at", "size", F.max(end).over(order).alias("before")).select(
        "row", F.greatest(end - F.greatest(F.col("at"), F.coalesce("before", F.lit(0))), F.lit(0)).alias("more"), (F.col("before").isNull() | (F.col("before") < F.col("at"))).alias("new"),
    ).groupBy("row").agg(F.sum("more").alias("n_hit"), F.count_if("new").alias("n_spans"))
    named = hits.select("row", "digest").distinct().join(ahead(held.select("digest", "item").distinct()), "digest").select("row", "item").distinct()
    lists = named.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    found = materialise(spans.join(lists, "row"), "winnow-found")
    discard(held, hits, collect=False)
    out = met.where("at = -1").select("row", "doc_id", "n_words").join(found, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_spans"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
