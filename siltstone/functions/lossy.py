"""Text from bytes that may have been cut anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(raw: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD: one for the start of a character
    that isn't finished, one for each byte that can't start any."""
    return F.make_valid_utf8(raw.cast("string"))


def first_bytes(text: Column, n: int) -> Column:
    """The first ``n`` bytes of a text, as text."""
    return decoded(F.substring(text.cast("binary"), 1, n))


def last_bytes(text: Column, n: int) -> Column:
    """The last ``n`` bytes of a text, as text."""
    raw = text.cast("binary")
    return decoded(F.when(F.octet_length(raw) > n, F.substring(raw, -n, n)).otherwise(raw))
