"""Scalar functions: dates, words and numbers in text, enums, JSON paths with strict types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The collectors in the order of results, and the profiles (fixed values).
COLLECTORS = ("fmt", "clippy", "tests", "coverage", "deny", "audit", "hack", "mutants", "duplicates", "loc", "size", "complexity")
PROFILES = ("fast", "full", "deep")
STATUSES = ("pass", "fail", "skipped", "error")
U32 = 4294967295


def iso_utc(seconds: Column) -> Column:
    """Seconds since 1970 as YYYY-MM-DDTHH:MM:SSZ, in any session time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    at = F.pmod(seconds, F.lit(86400))
    part = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), part(F.floor(at / 3600)), F.lit(":"), part(F.floor(F.pmod(at, F.lit(3600)) / 60)), F.lit(":"), part(F.pmod(at, F.lit(60))), F.lit("Z"))


def now_iso() -> Column:
    return iso_utc(F.unix_timestamp())


def epoch_parts(seconds: Column) -> dict[str, Column]:
    """year, month, day, hour, minute, second (UTC) of seconds since 1970."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    at = F.pmod(seconds, F.lit(86400)).cast("long")
    return {
        "year": F.year(day).cast("long"), "month": F.month(day).cast("long"), "day": F.dayofmonth(day).cast("long"),
        "hour": F.floor(at / 3600).cast("long"), "minute": F.floor(F.pmod(at, F.lit(3600)) / 60).cast("long"), "second": F.pmod(at, F.lit(60)).cast("long"),
    }


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def u32(value: Column) -> Column:
    """The low 32 bits, as a long."""
    return value.cast("long").bitwiseAND(F.lit(U32))


def u32_words(text: Column) -> Column:
    """The words of a text that are numbers of 32 bits, as longs, in order."""
    words = F.filter(F.split(text, r"[\t-\r \x{85}\p{Z}]+"), lambda w: w.rlike(r"\A\+?[0-9]+\z"))
    numbers = F.transform(words, lambda w: w.try_cast("decimal(38,0)"))
    return F.transform(F.filter(numbers, lambda n: n <= U32), lambda n: n.cast("long"))


def first_u32(text: Column) -> Column:
    """The first word that is a number of 32 bits, or null."""
    return F.get(u32_words(text), F.lit(0))


def parse_name(text: Column, names: tuple[str, ...]) -> Column:
    """A name of an enum, whatever its case, or null."""
    return F.when(F.lower(text).isin(*names), F.lower(text))


def parsed(text: Column) -> Column:
    """JSON text as a variant, or null where it is none."""
    return F.try_parse_json(text)


def _at(json: Column, path: str) -> tuple[Column, Column]:
    found = F.try_variant_get(json, path, "variant")
    return found, F.schema_of_variant(found)


def json_u64(json: Column, path: str) -> Column:
    """A whole number that is not negative. Booleans, strings and fractions are null."""
    _, kind = _at(json, path)
    value = F.try_variant_get(json, path, "bigint")
    return F.when((kind == "BIGINT") & (value >= 0), value)


def json_f64(json: Column, path: str) -> Column:
    """Any number. Booleans and strings are null."""
    _, kind = _at(json, path)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(json, path, "double"))


def json_str(json: Column, path: str) -> Column:
    _, kind = _at(json, path)
    return F.when(kind == "STRING", F.try_variant_get(json, path, "string"))


def json_items(json: Column, path: str) -> Column:
    """The items of an array as variants; null if there is no array."""
    return F.try_variant_get(json, path, "array<variant>")


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))
