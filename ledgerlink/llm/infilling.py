"""Fill-in-the-middle forms of documents by counted regular expressions.

A text is n units, each a run of ASCII letters or one other code point, so no cut falls into a
word. Two hashed cuts a <= b give the pattern ``(unit{a})(unit{b-a})(rest)`` of the row. Its
quantifiers are possessive: the matcher counts units in a loop, without backtracking and without
a stack that grows with the text. One match captures all three parts, and its replacement is the
output. Units are counted by the same means: blocks of ``BLOCK`` units first, then the rest, so
counting holds as many substrings as there are blocks and never one per unit.

The markers cannot occur in a part, since texts that hold one stay plain, and none of them
overlaps with itself or another; so the output gives back the text by one match as well.

A null text is empty, and an empty text stays plain. A null id draws like the text ``null``; equal
rows get equal outputs. Other columns of the rows stay, the new ones are one struct, ``fim``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
BLOCK = 1000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # of 100 draws, those from here on stay plain
SPM_BELOW = 20   # of 100 draws, those below put the suffix first
TEMPLATES = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
INVERSES = {
    "psm": (f"(?s)\\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\\z", "$1$3$2"),
    "spm": (f"(?s)\\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\\z", "$2$3$1"),
}


def n_units(text: Column) -> Column:
    """Units of a text. ``\\G`` lets a block begin only where the last one ended."""
    blocks = F.regexp_count(text, F.lit(f"\\G{UNIT}{{{BLOCK}}}+"))
    rest = F.regexp_replace(text, f"\\A(?:{UNIT}{{{BLOCK}}}+)++", "")
    return blocks.cast("long") * BLOCK + F.regexp_count(rest, F.lit(UNIT))


def draws(key: Column, seed: str) -> list[Column]:
    """Four unsigned numbers: the first 8-digit groups of the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def infilled(docs: DataFrame, seed: str = "1") -> DataFrame:
    """Rows of ``docs`` (doc_id, text and any others) with ``fim``: n, form, output, and the code
    points of prefix and middle (null in plain rows)."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    marked = F.greatest(*(F.contains(text, F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)))
    rows = docs.select(F.struct("*").alias("doc")).select("doc", text.alias("text"), n_units(text).alias("n"), F.array(*draws(F.col("doc.doc_id"), seed)).alias("h"))
    first, second = F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)
    form = F.when((F.col("text") == "") | marked | (F.col("h")[2] % 100 >= PLAIN_FROM), "plain").when(F.col("h")[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    cut = rows.select("doc", "text", "n", form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    unit = F.lit(f"({UNIT}{{")
    pattern = F.concat(F.lit("(?s)\\A"), unit, "a", F.lit("}+)"), unit, (F.col("b") - F.col("a")).cast("string"), F.lit("}+)(.*)\\z"))
    template = F.when(F.col("form") == "psm", TEMPLATES["psm"]).otherwise(TEMPLATES["spm"])
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, template))
    made = cut.select("doc", "n", "form", output.alias("output"))

    def place(marker: str) -> Column:
        return F.locate(marker, "output")

    end = F.when(F.col("form") == "psm", place(SUFFIX)).otherwise(place(MIDDLE))
    prefix = F.when(F.col("form") != "plain", end - place(PREFIX) - len(PREFIX)).cast("long")
    middle = F.when(F.col("form") != "plain", F.char_length("output") - place(MIDDLE) - len(MIDDLE) + 1).cast("long")
    return made.select("doc.*", F.struct("n", "form", "output", prefix.alias("prefix_chars"), middle.alias("middle_chars")).alias("fim"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output of a form was made from."""
    back = {name: F.regexp_replace(output, pattern, order) for name, (pattern, order) in INVERSES.items()}
    return F.when(form == "psm", back["psm"]).when(form == "spm", back["spm"]).otherwise(output)
