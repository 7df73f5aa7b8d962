"""Name, phone and code normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal words dropped from imported vendor names.
IMPORT_SUFFIX_WORDS = [
    "LLC", "INC", "CORP", "LTD", "LIMITED", "CORPORATION",
    "COMPANY", "CO", "ASSOCIATES", "ASSOC", "&", "AND",
]

# One trailing legal suffix stripped from stored vendor names.
STORED_SUFFIXES = (
    "INCORPORATED|INC|CORPORATION|CORP|COMPANY|CO|LIMITED|LTD|LLC|LP|LLP"
)

# Legal words removed when vendors are compared for duplicates.
DUPLICATE_SUFFIXES = "INC|INCORPORATED|LLC|LTD|LIMITED|CORP|CORPORATION|CO|COMPANY"

# Shape of an e-mail address and of a version-4 UUID.
EMAIL_PATTERN = r"^[^ \t\r\n@]+@[^ \t\r\n@]+\.[^ \t\r\n@]+$"
UUID4_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def import_vendor_name(c: Column) -> Column:
    """Upper case, single spaces, legal words dropped unless nothing would remain."""
    flat = collapse_spaces(F.upper(c))
    words = F.split(flat, " ")
    kept = F.filter(words, lambda w: ~w.isin(IMPORT_SUFFIX_WORDS))
    name = F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(flat)
    return F.substring(F.coalesce(name, F.lit("")), 1, 255)


def stored_vendor_name(c: Column) -> Column:
    """Upper case, punctuation except apostrophes removed, one trailing legal suffix off."""
    plain = F.regexp_replace(F.upper(F.trim(c)), r"[^A-Z0-9_ \t\r\n']", "")
    short = F.regexp_replace(plain, rf"[ \t\r\n]+({STORED_SUFFIXES})$", "")
    return collapse_spaces(short)


def duplicate_vendor_name(c: Column) -> Column:
    """Letters, digits and spaces only, legal words removed anywhere."""
    plain = F.regexp_replace(F.upper(F.trim(c)), r"[^A-Z0-9 \t\r\n]", "")
    return collapse_spaces(F.regexp_replace(plain, rf"\b({DUPLICATE_SUFFIXES})\b", ""))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def vendor_code_base(c: Column) -> Column:
    """First six alphanumerics in upper case, padded with X to at least three."""
    base = F.substring(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), 1, 6)
    return F.when(F.length(base) < 3, F.rpad(base, 3, "X")).otherwise(base)


def vendor_format_ok(c: Column) -> Column:
    return (F.length(c) >= 2) & c.rlike("[a-zA-Z]")


def matches_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL_PATTERN), F.lit(False))


def matches_uuid4(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(UUID4_PATTERN), F.lit(False))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")
