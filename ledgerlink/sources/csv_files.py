"""CSV import files: scans with source row numbers, and per-file profiles.

Line numbers come from the source, not from row order after a shuffle: rows keep their
order inside one scanned block, and a small table of rows per block gives each block its
offset in the file. This works for whole-file (quoted line breaks) and splittable scans.

There may be very many small files. Each is opened once: a scan is written to the shared folder and
all further steps read that table. Folders are listed and files scanned many to a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.functions.parse import date_like, numeric_text
from ledgerlink.session import staged

c = F.col

# Encodings, delimiters in the order ties resolve.
ENCODINGS = ["utf-8", "utf-16", "ascii", "iso-8859-1", "windows-1252"]
DELIMITERS = [",", "\t", "|", ";"]
HEADER_WORDS = ["invoice", "vendor", "amount", "date", "number", "total", "tax"]
MAX_ROWS = 10000


def with_positions(scan: DataFrame, name: str, first: int) -> DataFrame:
    """Number the rows of every file from ``first``; ``scan`` carries file, block and seq."""
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("seq"))
    sizes = scan.groupBy("file", "block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("_before"))
    return scan.withColumn("_i", inside).join(offsets, ["file", "block"]).withColumn(
        name, (c("_before") + c("_i") + F.lit(first - 1)).cast("int")).drop("block", "seq", "_i", "_before")


@contextmanager
def _many_to_a_task(spark: SparkSession) -> Iterator[None]:
    """Settings under which a listing task takes many folders and a scan task many small files."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism),
              "spark.sql.files.openCostInBytes": "262144"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _place() -> list[Column]:
    return [c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")]


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ",", header: bool = True,
             encoding: str = "utf-8", multi_line: bool = True) -> DataFrame:
    """All-string scan of files with one dialect, plus ``file`` and ``row_number``.

    The first data row is 2 when there is a header, else 1.
    """
    schema = ", ".join(f"`{x}` string" for x in columns)
    with _many_to_a_task(spark):
        scan = (spark.read.schema(schema).option("header", header).option("sep", sep).option("encoding", encoding).option("recursiveFileLookup", True)
                .option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("enforceSchema", True).csv(path))
        rows = staged(scan.select(*columns, *_place()), "scan")
    return with_positions(rows, "row_number", 2 if header else 1)


def read_headerless(spark: SparkSession, path: str, width: int, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """Columns ``column_1`` to ``column_n``."""
    return read_csv(spark, path, [f"column_{i}" for i in range(1, width + 1)], sep, False, encoding)


def map_columns(rows: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select the mapped source columns under their field names, trimmed."""
    return rows.select("file", "row_number", *[F.trim(c(source)).alias(field) for source, field in mapping.items()])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line) over all text files below ``path``."""
    with _many_to_a_task(spark):
        scan = spark.read.option("recursiveFileLookup", True).text(path).select(c("value").alias("line"), *_place())
        lines = staged(scan, "scan")
    return staged(with_positions(lines, "line_number", 1), "lines")


def read_plain(lines: DataFrame, sep: str) -> DataFrame:
    """Long-form cells of a naive scan: split on the delimiter, quotes stripped, blanks skipped.

    (file, row_number, column, value); the first kept line of a file names the columns and
    missing cells are empty texts.
    """
    kept = lines.filter(F.trim("line") != "")
    cells = F.transform(F.split(F.trim("line"), F.lit(r"\Q" + sep + r"\E")), lambda x: F.replace(F.trim(x), F.lit('"'), F.lit("")))
    first = kept.groupBy("file").agg(F.min("line_number").alias("head_at"))
    heads = kept.join(first, "file").filter("line_number = head_at").select("file", "head_at", cells.alias("names"))
    body = kept.join(heads, "file").filter("line_number > head_at").select("file", "line_number", "head_at", "names", cells.alias("cells"))
    return body.select("file", (c("line_number") - c("head_at") + 1).alias("row_number"), F.posexplode("names").alias("i", "column"), "cells").select(
        "file", "row_number", "column", F.coalesce(F.get("cells", c("i")), F.lit("")).alias("value"))


# --- per-file profiles -------------------------------------------------------------------


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding) of all text files below ``path``, judged by the bytes of all their lines.

    A byte-order mark means UTF-16. Else bytes below 128 only are ASCII, bytes that are valid UTF-8
    are that; of the rest, files with bytes from 80 to 9F, which ISO-8859-1 gives no characters, are
    Windows-1252. Lines are scanned in blocks and summed per file; no file is one cell.
    """
    scan = spark.read.option("recursiveFileLookup", True).text(path).select(c("value").alias("line"), *_place())
    lines = scan.select("file", "block", "seq", "line", F.hex(c("line").cast("binary")).alias("bytes"))
    per = lines.groupBy("file").agg(
        F.min_by(F.substring("bytes", 1, 4), F.struct("block", "seq")).alias("start"), F.bool_or(c("bytes").rlike("^(..)*?[89A-F]")).alias("high"),
        F.bool_and(F.is_valid_utf8("line")).alias("valid"), F.bool_or(c("bytes").rlike("^(..)*?[89]")).alias("control"))
    kind = (F.when(c("start").isin("FFFE", "FEFF"), "utf-16").when(~c("high"), "ascii").when(c("valid"), "utf-8").when(c("control"), "windows-1252").otherwise("iso-8859-1"))
    return per.select("file", kind.alias("encoding"))


#: What bytes 80 to 9F stand for in Windows-1252; the five that stand for nothing keep their code.
_HIGH = bytes(range(0x80, 0xA0))
_FROM_LATIN = _HIGH.decode("iso-8859-1")
_TO_WINDOWS = "".join(bytes([b]).decode("windows-1252", "ignore") or chr(b) for b in _HIGH)


def read_detected(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """All-string scan of files in mixed encodings, each read in the one found for it.

    There is one scan per encoding that occurs, at most as many as there are ``ENCODINGS``.
    Windows-1252 is read as ISO-8859-1, from which it differs in 32 characters that are put right
    afterwards.
    """
    files = staged(detect_encodings(spark, path), "encodings")
    out = None
    for encoding in sorted(r[0] for r in files.select("encoding").distinct().collect()):
        paths = [r[0] for r in files.filter(c("encoding") == encoding).select("file").collect()]
        rows = read_csv(spark, paths, columns, sep, header, "iso-8859-1" if encoding == "windows-1252" else {"ascii": "us-ascii"}.get(encoding, encoding))
        if encoding == "windows-1252":
            rows = rows.select(*(F.translate(x, _FROM_LATIN, _TO_WINDOWS).alias(x) for x in columns), "file", "row_number")
        out = rows if out is None else out.unionByName(rows)
    return out


def detect_delimiters(lines: DataFrame, sample: int = 10) -> DataFrame:
    """(file, delimiter): most frequent candidate in the first non-empty lines."""
    kept = lines.filter(F.trim("line") != "")
    top = W.partitionBy("file").orderBy("line_number")
    head = kept.withColumn("n", F.row_number().over(top)).filter(c("n") <= sample)
    count = lambda d: F.sum(F.length("line") - F.length(F.replace(c("line"), F.lit(d), F.lit(""))))
    sums = head.groupBy("file").agg(*[count(d).alias(f"d{i}") for i, d in enumerate(DELIMITERS)])
    best = F.greatest(*[F.struct(c(f"d{i}").alias("n"), F.lit(-i).alias("order"), F.lit(d).alias("mark")) for i, d in enumerate(DELIMITERS)])
    return sums.select("file", best["mark"].alias("delimiter"))


def detect_headers(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """(file, has_header) from the first two non-empty lines.

    A header when under half of the first row and over 30 % of the second row are numeric,
    or when two header words occur; a one-line file counts as header.
    """
    kept = lines.filter(F.trim("line") != "")
    top = W.partitionBy("file").orderBy("line_number")
    two = kept.withColumn("n", F.row_number().over(top)).filter(c("n") <= 2).join(delimiters, "file")
    cells = F.split("line", F.concat(F.lit(r"\Q"), c("delimiter"), F.lit(r"\E")))
    cells = F.transform(cells, lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    share = F.size(F.filter(cells, lambda x: numeric_text(x))) / F.size(cells)
    words = sum((F.contains(F.lower("line"), F.lit(w)).cast("int") for w in HEADER_WORDS), F.lit(0))
    rows = two.select("file", "n", share.alias("share"), words.alias("words"))
    per = rows.groupBy("file").agg(F.max("n").alias("n"), F.max(F.when(c("n") == 1, c("share"))).alias("s1"), F.max(F.when(c("n") == 2, c("share"))).alias("s2"),
                                   F.max(F.when(c("n") == 1, c("words"))).alias("words"))
    return per.select("file", ((c("n") < 2) | ((c("s1") < 0.5) & (c("s2") > 0.3)) | (c("words") >= 2)).alias("has_header"))


def file_profiles(lines: DataFrame, delimiters: DataFrame, headers: DataFrame, preview: int = 10) -> DataFrame:
    """(file, columns, data_rows, characters, preview, too_many_rows) with true counts."""
    counts = lines.filter(F.trim("line") != "").groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.length("line") + 1).alias("characters"))
    head = lines.filter(c("line_number") <= preview + 1).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("line_number", "line"))).alias("top"))
    rows = counts.join(head, "file").join(delimiters, "file").join(headers, "file")
    first = c("top")[0]["line"]
    width = F.length(first) - F.length(F.replace(first, c("delimiter"), F.lit(""))) + 1
    data = c("lines") - c("has_header").cast("int")
    texts = F.transform(F.slice("top", F.when(c("has_header"), 2).otherwise(1), F.lit(preview)), lambda x: x["line"])
    return rows.select("file", width.alias("columns"), data.alias("data_rows"), "characters", F.array_join(texts, "\n").alias("preview"),
                       (data > MAX_ROWS).alias("too_many_rows"))


def column_profiles(rows: DataFrame, keys: list[str], order: str, columns: list[str], checked: int = 20, samples: int = 5) -> DataFrame:
    """(keys, column, type, filled, samples) from the first non-empty values of each column."""
    long = rows.unpivot([*keys, order], columns, "column", "value").filter(F.trim("value") != "").withColumn("value", F.trim("value"))
    filled = long.groupBy(*keys, "column").agg(F.count("*").alias("filled"))
    first = long.withColumn("n", F.row_number().over(W.partitionBy(*keys, "column").orderBy(order))).filter(c("n") <= checked)
    number = numeric_text(c("value"))
    per = first.groupBy(*keys, "column").agg(
        F.count("*").alias("k"), F.count_if(number).alias("numbers"), F.count_if(~number & date_like(c("value"))).alias("dates"),
        F.sort_array(F.collect_list(F.when(c("n") <= samples, F.struct("n", "value")))).alias("top"))
    kind = F.when(c("numbers") / c("k") > 0.8, "numeric").when(c("dates") / c("k") > 0.6, "date").otherwise("text")
    return filled.join(per, [*keys, "column"]).select(
        *keys, "column", kind.alias("type"), "filled", F.array_join(F.transform("top", lambda x: x["value"]), "|").alias("samples"))
