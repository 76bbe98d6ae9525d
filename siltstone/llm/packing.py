"""Harmonic packing of tokenised documents into fixed-length training sequences.

A document's ids are cut into pieces whose lengths are reciprocals of the capacity:
class k holds pieces of capacity // k ids, and each of its sequences takes exactly k of
them. Workers fill classes independently: a piece's sequence follows from its number
within its class, which is a count in its own partition plus a prefix sum over the
partitions' counts. What is shorter than the smallest class (the last class of the
harmonic scheme) flows in document order through the room that is left, and is cut
where a sequence ends.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import map_arrow, materialise

#: Classes 1 to CLASSES. Shorter pieces, at most capacity / CLASSES ids, flow.
CLASSES = 32
#: Encoded words, and parts of words, that a worker holds before it starts afresh.
CACHED_WORDS, CACHED_PARTS = 250_000, 500_000
#: The rules of a tokenizer whose words can be encoded one by one: white space only ends
#: a word, and nothing is joined across it.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: Words of Latin letters, ASCII digits and signs. NFC leaves them as they are, a lower-case
#: letter is one letter, and ``PART`` cuts them as the rules above do.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u017f]+")

_ENCODERS: dict[str, "_Encoder"] = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Parts(dict):
    """Part of a plain word -> its ids, from the tokenizer's model alone: most words that
    were not seen before are made of parts that were."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        from tokenizers import pre_tokenizers

        self.model = tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x180)) if PLAIN.fullmatch(c)}

    def __missing__(self, part: str) -> bytes:
        found = _packed([t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.as_bytes))])
        if len(self) >= CACHED_PARTS:
            self.clear()
        if len(part) <= 64:
            self[part] = found
        return found


class _Encoder(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, and texts to ids: word
    by word if the tokenizer's rules are those of ``BY_WORD``, else each text as a whole."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        tokens = rules["added_tokens"]
        self.added = re.compile("|".join(re.escape(t["content"]) for t in tokens) or "(?!)")
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].isalpha()) and len(t["content"].split()) == 1 for t in tokens)
        self.by_word = plain and rules["model"]["type"] == "BPE" and all(rules[k] == v for k, v in BY_WORD.items())
        self.parts = _Parts(self.tokenizer) if self.by_word else {}

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if self.by_word else self.whole(text.decode("utf-8", "replace"))

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            found = self.parts[text.lower()]
        elif PLAIN.fullmatch(text) and not self.added.search(text):
            found = b"".join(map(self.parts.__getitem__, PART.findall(text.lower())))
        else:
            found = self.whole(text)
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int, classes: int) -> list[tuple[int, int]]:
    """(class, length) of the pieces of n ids; class 0 is the flowing rest."""
    found = [(1, capacity)] * (n // capacity)
    left = n % capacity
    least = capacity // classes
    while left >= least and left:
        k = -(-capacity // left)
        while capacity // k > left:
            k += 1
        found.append((k, capacity // k))
        left -= capacity // k
    return found + [(0, left)] * (left > 0)


def _pieces(path: str, capacity: int, classes: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, at = _encoder(path), [0] * (classes + 1)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "at", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text or b"") + end
                n, start = len(ids) // 4, 0
                for k, length in cuts(n, capacity, classes):
                    held = ids[4 * start : 4 * (start + length)]
                    for values, x in zip(out, (doc, start, length, zlib.crc32(held), n, k, part, at[k], None if k else held), strict=True):
                        values.append(x)
                    at[k] += 1 if k else length
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, classes: int = CLASSES, end_id: int = 2) -> DataFrame:
    """Return per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.

    * null and empty text give the end id alone; a text of any length is used whole
    * ids are those of the whole text, whatever the rules of the tokenizer
    * repeated rows and repeated or null ids are packed as so many documents
    * sequence ids run from 0 without gaps; pieces fill each sequence from offset 0
    * an empty table gives an empty result; other columns are ignored

    At most ``classes`` + 1 rows (counts of the classes) reach the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, at long, ids binary"
    pieces = materialise(map_arrow(rows, _pieces(tokenizer, capacity, classes, end_id), schema), "pack-pieces")
    filled = pieces.groupBy("class", "part").agg(F.sum(F.when(F.col("class") == 0, F.col("length")).otherwise(1)).alias("filled"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = filled.select("class", "part", F.coalesce(F.sum("filled").over(before), F.lit(0)).alias("ahead"))
    counts = {r[0]: r[1] for r in filled.groupBy("class").agg(F.sum("filled")).collect()}
    base, bases, room = 0, {0: 0}, []
    for k in range(1, classes + 1):
        bases[k], n = base, counts.get(k, 0)
        base += -(-n // k)
        if n % k:  # the class's last sequence, and where its free room starts
            room.append((base - 1, n % k * (capacity // k)))
    numbered = pieces.join(ahead, ["class", "part"]).withColumn("at", F.col("at") + F.col("ahead"))
    k = F.col("class")
    whole = numbered.where("class > 0").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.element_at(F.array(*[F.lit(bases[c]).cast("long") for c in range(classes + 1)]), k + 1) + F.floor(F.col("at") / k)).alias("sequence_id"),
        (F.col("at") % k * F.floor(F.lit(capacity) / k)).alias("offset"),
    )
    # The flow: position -> sequence and offset, first through the room in the classes'
    # last sequences, then through sequences of its own.
    ends, total = [], 0
    for _, used in room:
        total += capacity - used
        ends.append(total)

    def place(g: Column) -> tuple[Column, Column, Column]:
        own = g - total
        seq, off, left = F.lit(base) + F.floor(own / capacity), own % capacity, capacity - own % capacity
        for (sequence, used), upto in reversed(list(zip(room, ends, strict=True))):
            first = upto - (capacity - used)
            inside = (g >= first) & (g < upto)
            seq, off, left = F.when(inside, F.lit(sequence)).otherwise(seq), F.when(inside, g - first + used).otherwise(off), F.when(inside, upto - g).otherwise(left)
        return seq.cast("long"), off.cast("long"), left.cast("long")

    flow = numbered.where("class = 0")
    first = F.least("length", place(F.col("at"))[2])
    flow = flow.select("*", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("skip"), first.alias("take")), F.struct(first.alias("skip"), (F.col("length") - first).alias("take")))).alias("cut")).where("cut.take > 0")
    flow = flow.withColumn("g", F.col("at") + F.col("cut.skip"))
    seq, off, _ = place(F.col("g"))
    crc = F.crc32(F.expr("substring(ids, cast(4 * cut.skip + 1 as int), cast(4 * cut.take as int))"))
    flow = flow.select("doc_id", (F.col("start") + F.col("cut.skip")).alias("start"), F.col("cut.take").alias("length"), crc.alias("ids_crc32"), "doc_tokens", seq.alias("sequence_id"), off.alias("offset"))
    return whole.unionByName(flow)
