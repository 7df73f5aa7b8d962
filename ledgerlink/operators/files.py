"""Content checks over named texts: suspicious patterns, file rules, entropy, equal content."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions.numeric import round_half_up

cloudpickle.register_pickle_by_value(sys.modules[__name__])

c = F.col

# Patterns that mark a text as suspicious, by number.
SUSPICIOUS = [
    r"<script[^>]*>", r"javascript:", r"vbscript:", r"onload\s*=", r"onclick\s*=", r"onerror\s*=",
    r"(union|select|insert|update|delete|drop|create|alter)\s+", r"(exec|execute)\s*\(", r"(script|javascript|vbscript)",
    r"(\||;|&|\$\(|`)", r"(cmd\.exe|powershell\.exe|bash|sh)", r"(rm\s+-rf|del\s+/|format\s+)",
    r"\.\./", r"\.\.\\", r"/etc/passwd", r"/etc/shadow", r"windows/system32",
    r"^MZ", r"^PK", r"^\x7fELF",
]
# Fixed value: a signature that is no text in UTF-8; it is looked for in the bytes.
BYTE_SIGNATURE = "CAFEBABE"
# Name patterns and limits of the file rules.
BAD_NAMES = [r"\.{2,}", r'[<>:"|?*]', r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"]
ALLOWED_ENDINGS = ["csv", "txt"]
MAX_BYTES, MAX_LINES, MAX_LINE, MAX_DELIMITERS = 50 * 1024 * 1024, 50000, 100000, 1000


def suspicious(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern_id) for every pattern found anywhere in the whole text (text or bytes); the
    last one is the byte signature at the start of a line."""
    body = c(text).cast("string")
    hits = [F.when(body.rlike("(?im)" + p), F.lit(i)) for i, p in enumerate(SUSPICIOUS, 1)]
    signed = F.hex(c(text).cast("binary")).rlike(f"^(..)*?(?<=^|0A|0D){BYTE_SIGNATURE}")
    hits.append(F.when(signed, F.lit(len(SUSPICIOUS) + 1)))
    return texts.select(key, F.explode(F.array_compact(F.array(*hits))).alias("pattern_id"))


def file_rules(files: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """(key, rule) for every broken file rule."""
    body, label = c(text), c(name)
    ending = F.lower(F.regexp_extract(label, r"\.([^./]+)$", 1))
    lines = F.split(body, "\n")
    first = F.element_at(lines, 1)
    marks = F.greatest(*[F.length(first) - F.length(F.replace(first, F.lit(d), F.lit(""))) for d in (",", "\t", "|", ";")])
    rules = [
        (F.length(body) == 0, "empty"), (F.octet_length(body) > MAX_BYTES, "too_large"), ((label == "") | (F.length(label) > 255), "invalid_name"),
        (~ending.isin(ALLOWED_ENDINGS), "extension"), *[(label.rlike("(?i)" + p), f"name_pattern_{i}") for i, p in enumerate(BAD_NAMES, 1)],
        (F.size(lines) > MAX_LINES, "too_many_lines"), (F.exists(lines, lambda x: F.length(x) > MAX_LINE), "line_too_long"),
        ((F.trim(first) != "") & (marks == 0), "no_delimiter"), (marks > MAX_DELIMITERS, "delimiter_count"),
    ]
    return files.select(key, F.explode(F.array_compact(F.array(*[F.when(when, F.lit(label_)) for when, label_ in rules]))).alias("rule"))


def byte_entropy(texts: DataFrame, key: str, text: str, limit: float = 7.5) -> DataFrame:
    """(key, entropy, high): Shannon entropy in bits over all bytes of each text; texts without a
    byte have no row. The bytes of a text are counted where it lies, nothing is shuffled."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            values = []
            for body in bodies:
                n = np.bincount(np.frombuffer(body.as_buffer(), np.uint8), minlength=1) if body.as_buffer().size else np.zeros(1)
                n = n[n > 0].astype(np.float64)
                values.append(float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum()) if len(n) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["key", "entropy"])

    found = texts.select(key, text).mapInArrow(run, f"key {kind}, entropy double").filter(c("entropy").isNotNull())
    return found.select(c("key").alias(key), round_half_up(c("entropy"), 4).alias("entropy"), (c("entropy") > limit).alias("high"))


def equal_content(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(content_hash, first key, copies) per distinct content."""
    return texts.groupBy(F.sha2(c(text), 256).alias("content_hash")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def unseen(texts: DataFrame, key: str, text: str, known_hashes: DataFrame) -> DataFrame:
    """Texts whose content hash is not known yet, one per hash."""
    return equal_content(texts, key, text).join(known_hashes, "content_hash", "left_anti")
