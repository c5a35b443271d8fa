"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, r"\s+"), "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squash(text: Column) -> Column:
    """Small letters, ASCII punctuation as spaces, single spaces: the form in which texts are compared."""
    plain = F.regexp_replace(lower_ascii(text), r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", " ")
    return F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))


def char_class(c: Column) -> Column:
    """lower, upper, digit (by Unicode's categories), space, punct (ASCII) or other, of a single character."""
    return (
        F.when(c.rlike(r"^\p{Ll}$"), "lower").when(c.rlike(r"^\p{Lu}$"), "upper").when(c.rlike(r"^\p{Nd}$"), "digit")
        .when(c.rlike(r"^[\x20\x09-\x0D]$"), "space").when(c.rlike(r"^[\x21-\x7E]$"), "punct").otherwise("other")
    )


def parse_label(raw: Column, labels: list[str]) -> tuple[Column, Column]:
    """(strict, lenient) readings of a free answer: the whole answer without punctuation around it, and the first whole-word label in it."""
    low = lower_ascii(raw)
    bare = F.regexp_replace(low, r"^[^a-z]+|[^a-z]+$", "")
    first = F.regexp_extract(low, r"\b(" + "|".join(labels) + r")\b", 1)
    return F.when(bare.isin(labels), bare), F.when(first != "", first)


def byte_ids(text: Column, offset: int = 6) -> Column:
    """UTF-8 bytes as token ids, shifted past the special ids."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: (F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int") + offset))
    )


def decoded(ids: Column, offset: int = 6) -> Column:
    """The text of byte token ids: special ids are left out, and bytes that aren't UTF-8 become U+FFFD."""
    two = F.transform(F.filter(ids, lambda i: i >= offset), lambda i: F.lpad(F.hex(i - offset), 2, "0"))
    return F.make_valid_utf8(F.unhex(F.array_join(two, "")).cast("string"))
