"""Fill-in-the-middle training texts.

Each text is decoded to an array of code points (UTF-32). Every code point has a class;
where the classes of neighbours differ, a unit ends. A text is cut after two chosen
numbers of units, and its pieces are put in the order of a form, each after its mark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle. A text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that are rearranged, and of 100 of these, those in suffix-first form.
RATE, SUFFIX_FIRST = 90, 20
UNITS = ("codepoint", "class")
#: A batch that goes back to Spark ends when its texts have this many bytes.
BATCH_BYTES = 4 << 20

_SPACES = np.array([0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def decode(text: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes. A byte that isn't UTF-8 is one unit of its own
    (U+DC80 and above), so that ``encode`` gives the same bytes again."""
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def encode(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """The class of each code point. ``codepoint``: each is a class of its own.
    ``class``: white space; digits; ASCII punctuation; all else (letters)."""
    if unit == "codepoint":
        return np.arange(len(points))
    if unit != "class":
        raise ValueError(f"unit is one of {UNITS}, not {unit!r}")
    found = np.full(len(points), 3, np.int8)
    found[points < 0x80] = 2
    found[(points >= 0x41) & (points <= 0x5A) | (points >= 0x61) & (points <= 0x7A)] = 3
    found[(points >= 0x30) & (points <= 0x39)] = 1
    found[np.isin(points, _SPACES)] = 0
    return found


def ends(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units end, from 0 (no unit) to the length of the text (all of them)."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = classes(points, unit)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]])


def _cut(unit: str, marks: tuple[str, str, str], rate: int, suffix_first: int):
    p, s, m = (x.encode() for x in marks)

    def one(text: bytes, h: tuple[int, int, int, int]) -> tuple:
        points = decode(text)
        at = ends(points, unit)
        n = len(at) - 1
        if not n or h[2] % 100 >= rate or p in text or s in text or m in text:
            return n, "plain", None, None, text
        a, b = sorted((int(at[h[0] % (n + 1)]), int(at[h[1] % (n + 1)])))
        before, middle, after = encode(points[:a]), encode(points[a:b]), encode(points[b:])
        if h[3] % 100 < suffix_first:
            return n, "spm", a, b - a, s + after + p + before + m + middle
        return n, "psm", a, b - a, p + before + s + after + m + middle

    names, kinds = ["n", "form", "prefix_chars", "middle_chars", "output"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, held, out = 0, 0, [[] for _ in names]
            for i in range(batch.num_rows):
                made = one(batch.column(1)[i].as_py() or b"", tuple(batch.column(2)[i].as_py()))
                for column, x in zip(out, made, strict=True):
                    column.append(x)
                held += len(made[-1])
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    arrays = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, i + 1 - lo), *arrays], ["doc_id", *names])
                    lo, held, out = i + 1, 0, [[] for _ in names]

    return run


def draws(id_col: Column, salt: int = 1) -> Column:
    """Four unsigned 32-bit integers from the id: the first four groups of eight digits
    of the hexadecimal SHA-256 of salt:id."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "codepoint", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: int = 1) -> DataFrame:
    """Return per input row: doc_id, n (units), form, prefix_chars, middle_chars (code
    points), output.

    The prefix ends after the smaller of two numbers of units drawn from the id, the
    middle after the larger; forms are plain (the text as it is), psm (prefix, suffix,
    middle) and spm (suffix, prefix, middle).

    * null and empty texts are plain and empty; so is, as it is, a text with a mark in it
    * a null id draws as an empty one; repeated rows and ids draw the same numbers
    * a byte that isn't UTF-8 counts as one code point and comes back as it was
    * an empty table gives an empty result; other columns are ignored
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}, not {unit!r}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), draws(F.col(id_col), salt).alias("draws"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return rows.mapInArrow(_cut(unit, marks, rate, suffix_first), schema).withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column, *, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from. Texts hold no marks, so that each mark is
    in the output once, and each piece is what follows its mark."""
    p, s, m = marks
    after = lambda mark, *until: _until(F.substring_index(output, mark, -1), *until)

    def _until(piece: Column, *until: str) -> Column:
        for mark in until:
            piece = F.substring_index(piece, mark, 1)
        return piece

    whole = F.concat(after(p, s, m), after(m, p, s), after(s, p, m))
    return F.when(form == "plain", output).otherwise(whole)
