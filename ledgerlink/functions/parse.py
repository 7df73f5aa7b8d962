"""Dates and amounts read from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts in the order they are tried, each with the shape
# that anchors it so that two- and four-digit years cannot be confused.
DATE_LAYOUTS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("M/d/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
]

# Currency marks removed before an amount is read.
CURRENCY_MARKS = ["$", "€", "£", "¥", "₹", "USD", "EUR", "GBP", "JPY", "INR"]

# Text that looks like the start of a date.
DATE_LIKE = r"^[ \t]*(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4})"

# A decimal number with optional exponent.
NUMBER_SHAPE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def read_date(c: Column, as_of_year: int) -> Column:
    """First layout that parses into a year between 1900 and ten years past ``as_of_year``."""
    text = F.trim(c)
    tries = []
    for layout, shape in DATE_LAYOUTS:
        day = F.when(text.rlike(shape), F.try_to_date(text, layout))
        if layout.endswith("yy") and not layout.endswith("yyyy"):
            day = F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)
        tries.append(F.when(F.year(day).between(1900, as_of_year + 10), day))
    return F.coalesce(*tries)


def read_money(c: Column) -> Column:
    """Amount to two places (half-even); parentheses or a leading minus mean negative."""
    text = F.trim(c)
    bare = text
    for mark in CURRENCY_MARKS:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    bare = F.regexp_replace(bare, r"[() ,]", "")
    bracketed = F.contains(c, F.lit("(")) & F.contains(c, F.lit(")"))
    negative = bare.startswith("-") | bracketed
    body = F.regexp_replace(bare, r"^-+", "")
    number = F.when(body.rlike(NUMBER_SHAPE), body.try_cast("decimal(30,8)"))
    rounded = F.bround(number, 2).cast("decimal(18,2)")
    return F.when(negative, -rounded).otherwise(rounded)


def read_loose_amount(c: Column) -> Column:
    """Keep digits, dot and minus; null unless the rest is a positive number."""
    value = F.regexp_replace(c, "[^0-9.-]", "").try_cast("double")
    return F.when(value > 0, value)


def numeric_text(c: Column) -> Column:
    """True when only currency marks, commas and blanks surround a number."""
    bare = F.regexp_replace(c, r"[$€£¥₹, \t\r\n]", "")
    return F.coalesce(bare.rlike(NUMBER_SHAPE), F.lit(False))


def date_like(c: Column) -> Column:
    return F.coalesce(c.rlike(DATE_LIKE), F.lit(False))


def leading_int(c: Column) -> Column:
    """The integer a text starts with, null when it starts otherwise."""
    return F.regexp_extract(F.trim(c), r"^([+-]?\d+)", 1).try_cast("int")
