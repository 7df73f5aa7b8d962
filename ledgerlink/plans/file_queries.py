"""CSV files written from the import rows and read back, and content checks on texts."""

from pyspark.sql import functions as F

from ledgerlink.operators import files, match, report
from ledgerlink.plans import registry
from ledgerlink.plans.match_queries import _BANDRUN
from ledgerlink.plans.oracle_ctes import sql_numeric_text, sql_round
from ledgerlink.plans.report_queries import _DAILY, _DCOLS
from ledgerlink.session import CODEC, scratch_path, staged
from ledgerlink.sources import csv_files

query = registry.query
c = F.col
FIELDS = ["invoice_number", "vendor_name", "total_amount", "invoice_date", "tax_amount", "subtotal", "due_date", "description", "po_reference", "payment_terms", "email"]
_WRITTEN: dict[tuple[str, str], str] = {}


def import_folder(e) -> str:
    """Write the import rows as CSV files below dialect=<0-3>/header=<0|1>, one per batch."""
    key = (e.spark.sparkContext.applicationId, e.sf_dir)
    if key in _WRITTEN:
        return _WRITTEN[key]
    path = scratch_path(e.spark, "import-files")
    dialect = (c("import_batch_id") % 4).cast("int")
    mark = F.element_at(F.array(*[F.lit(d) for d in csv_files.DELIMITERS]), dialect + 1)

    def cell(x):
        quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.contains(x, F.lit('"')) | F.contains(x, mark), quoted).otherwise(F.coalesce(x, F.lit("")))

    rows = e.import_rows
    names = ["import_batch_id", *FIELDS]
    line = F.concat_ws("\u0001", *[cell(c(n).cast("string")) for n in names])
    has_header = (c("import_batch_id") % 5 != 4).cast("int")
    body = rows.select("import_batch_id", dialect.alias("dialect"), has_header.alias("header"), c("row_number").alias("at"), F.replace(line, F.lit("\u0001"), mark).alias("line"))
    head = rows.select("import_batch_id", dialect.alias("dialect"), has_header.alias("header")).distinct().filter("header = 1").select(
        "import_batch_id", "dialect", "header", F.lit(1).alias("at"),
        F.concat_ws("\u0001", *[F.lit(n) for n in names]).alias("line")).withColumn("line", F.replace("line", F.lit("\u0001"), mark))
    # The sort starts with the partition columns, so the writer keeps it and files stay in row order.
    (head.unionByName(body).withColumnRenamed("import_batch_id", "batch").repartition("batch")
     .sortWithinPartitions("dialect", "header", "batch", "at").select("dialect", "header", "batch", "line").write.partitionBy("dialect", "header", "batch").text(path))
    _WRITTEN[key] = path
    return path


def _dialects(e, header: int) -> list[int]:
    """Dialects that occur among the batches with or without header (at most four)."""
    keyed = e.import_rows.select("import_batch_id").distinct().filter((c("import_batch_id") % 5 != 4).cast("int") == header)
    return sorted(r[0] for r in keyed.select((c("import_batch_id") % 4).cast("int")).distinct().collect())


def _scan(e, header: int):
    """All dialect folders with or without header, as one frame."""
    out = None
    for i in _dialects(e, header):
        mark = csv_files.DELIMITERS[i]
        folder = f"{import_folder(e)}/dialect={i}/header={header}"
        names = ["import_batch_id", *FIELDS]
        part = (csv_files.read_csv(e.spark, folder, names, mark) if header
                else csv_files.read_headerless(e.spark, folder, len(names), mark))
        out = part if out is None else out.unionByName(part)
    return out


_ORDERED = "SELECT *, row_number() OVER (PARTITION BY import_batch_id ORDER BY row_number) AS place FROM import_rows"


@query("s01_csv_scan", "import_batch_id bigint, row_number int, invoice_number string, vendor_name string, total_amount string, description string",
       f"SELECT import_batch_id, place + 1 AS row_number, nullif(trim(invoice_number), '') AS invoice_number, nullif(vendor_name, '') AS vendor_name, total_amount, description FROM ({_ORDERED}) WHERE import_batch_id % 5 <> 4", stored=True)
def _(e):
    rows = csv_files.map_columns(_scan(e, 1), {n: n for n in ["import_batch_id", *FIELDS]})
    return rows.withColumn("invoice_number", F.nullif(c("invoice_number"), F.lit("")))


@query("s02_headerless_scan", "column_1 bigint, row_number int, column_2 string, column_4 string",
       f"SELECT import_batch_id AS column_1, place AS row_number, nullif(trim(invoice_number), '') AS column_2, total_amount AS column_4 FROM ({_ORDERED}) WHERE import_batch_id % 5 = 4", stored=True)
def _(e):
    return _scan(e, 0).withColumn("column_2", F.nullif(F.trim("column_2"), F.lit("")))


def _batch(df):
    return df.withColumn("import_batch_id", F.regexp_extract("file", "batch=([0-9]+)", 1).cast("bigint"))


def _lines(e):
    return csv_files.read_lines(e.spark, import_folder(e))


_MARK = "CASE import_batch_id % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN '|' ELSE ';' END"
_CELLS = ", ".join(f"""CASE WHEN contains({n}, '"') OR contains({n}, mark) THEN '"' || replace({n}, '"', '""') || '"' ELSE coalesce({n}, '') END""" for n in FIELDS)
# The lines as they were written: a header line for four batches in five, then the rows.
_FILE_LINES = f"""SELECT import_batch_id, mark, 0 AS place, list_reduce(['import_batch_id', {', '.join(repr(n) for n in FIELDS)}], lambda a, b: a || mark || b) AS line FROM (SELECT DISTINCT import_batch_id, {_MARK} AS mark FROM import_rows) WHERE import_batch_id % 5 <> 4
    UNION ALL SELECT import_batch_id, mark, row_number, list_reduce([import_batch_id::VARCHAR, {_CELLS}], lambda a, b: a || mark || b) FROM (SELECT *, {_MARK} AS mark FROM import_rows)"""


@query("s03_plain_scan", "import_batch_id bigint, row_number int, name string, value string",
       f"""SELECT import_batch_id, n + 1 AS row_number, fields[i] AS name, coalesce(trim(replace(string_split(line, mark)[i], '"', '')), '') AS value
           FROM (SELECT *, row_number() OVER (PARTITION BY import_batch_id ORDER BY place) AS n FROM ({_FILE_LINES}) WHERE place > 0), (SELECT ['import_batch_id', {', '.join(repr(n) for n in FIELDS)}] AS fields), range(1, {len(FIELDS) + 2}) AS t(i)
           WHERE import_batch_id % 5 <> 4""", stored=True)
def _(e):
    out = None
    for i in _dialects(e, 1):
        part = csv_files.read_plain(csv_files.read_lines(e.spark, f"{import_folder(e)}/dialect={i}/header=1"), csv_files.DELIMITERS[i])
        out = part if out is None else out.unionByName(part)
    return _batch(out).withColumnRenamed("column", "name")


_NAMES = "['utf-8', 'utf-16', 'ascii', 'iso-8859-1', 'windows-1252'][import_batch_id % 5 + 1]"
_MARKS = "['Zürich €', 'Łódź €', 'Basel', 'Zürich', 'Zürich – €'][import_batch_id % 5 + 1]"


def encoded_folder(e) -> str:
    """Number, vendor and place of the import rows, a file per batch, in five encodings by batch."""
    path = scratch_path(e.spark, "encoded-files")
    marks = ["Zürich €", "Łódź €", "Basel", "Zürich", "Zürich – €"]
    place = F.element_at(F.array(*map(F.lit, marks)), (c("import_batch_id") % 5 + 1).cast("int"))
    rows = e.import_rows.select("import_batch_id", "row_number", F.trim("invoice_number").alias("invoice_number"), "vendor_name", place.alias("place"))

    def write(key, group):
        """Batches are some hundred rows; the file is written under a name of its own."""
        import csv
        import io

        import pyarrow as pa
        import pyarrow.fs

        batch = key[0].as_py()
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\n")
        out.writerow(["batch", "invoice_number", "vendor_name", "place"])
        for r in sorted(group.to_pylist(), key=lambda r: r["row_number"]):
            out.writerow([batch, r["invoice_number"], r["vendor_name"], r["place"]])
        fs, base = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        fs.create_dir(f"{base}/batch={batch}", recursive=True)
        with fs.open_output_stream(f"{base}/batch={batch}/rows.csv") as f:
            f.write(text.getvalue().encode(csv_files.ENCODINGS[batch % 5]))
        return pa.table({"batch": [batch]})

    rows.groupBy("import_batch_id").applyInArrow(write, "batch long").count()
    return path


@query("s04_file_encodings", "import_batch_id bigint, encoding string", f"SELECT DISTINCT import_batch_id, {_NAMES} AS encoding FROM import_rows", stored=True)
def _(e):
    return _batch(csv_files.detect_encodings(e.spark, encoded_folder(e)))


@query("s04_decoded_rows", "import_batch_id bigint, row_number int, invoice_number string, vendor_name string, place string",
       f"SELECT import_batch_id, row_number() OVER (PARTITION BY import_batch_id ORDER BY row_number) + 1 AS row_number, nullif(trim(invoice_number), '') AS invoice_number, nullif(vendor_name, '') AS vendor_name, {_MARKS} AS place FROM import_rows", stored=True)
def _(e):
    rows = csv_files.read_detected(e.spark, encoded_folder(e), ["batch", "invoice_number", "vendor_name", "place"])
    return rows.withColumnRenamed("batch", "import_batch_id")


@query("s05_file_delimiters", "import_batch_id bigint, delimiter string",
       "SELECT DISTINCT import_batch_id, CASE import_batch_id % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN '|' ELSE ';' END AS delimiter FROM import_rows", stored=True)
def _(e):
    return _batch(csv_files.detect_delimiters(_lines(e)))


_HEADED = f"""SELECT import_batch_id, count(*) < 2 OR (max(share) FILTER (WHERE n = 1) < 0.5 AND max(share) FILTER (WHERE n = 2) > 0.3) OR max(words) FILTER (WHERE n = 1) >= 2 AS has_header
    FROM (SELECT *, len(list_filter(cells, lambda x: {sql_numeric_text('x')})) / len(cells) AS share, {' + '.join(f"contains(lower(line), '{w}')::INT" for w in csv_files.HEADER_WORDS)} AS words
          FROM (SELECT *, list_transform(string_split(line, mark), lambda x: trim(replace(x, '"', ''))) AS cells, row_number() OVER (PARTITION BY import_batch_id ORDER BY place) AS n FROM ({_FILE_LINES})) WHERE n <= 2)
    GROUP BY import_batch_id"""


@query("s06_file_headers", "import_batch_id bigint, has_header boolean", _HEADED, stored=True)
def _(e):
    lines = _lines(e)
    return _batch(csv_files.detect_headers(lines, staged(csv_files.detect_delimiters(lines), "delimiters")))


@query("s07_file_profiles", "import_batch_id bigint, columns int, data_rows bigint, characters bigint, preview string, too_many_rows boolean",
       f"""SELECT l.import_batch_id, length(first(line ORDER BY place)) - length(replace(first(line ORDER BY place), any_value(mark), '')) + 1 AS columns, count(*) - any_value(has_header)::INT AS data_rows,
           sum(length(line) + 1) AS characters, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE n > has_header::INT AND n <= 10 + has_header::INT) AS preview, count(*) - any_value(has_header)::INT > 10000 AS too_many_rows
           FROM (SELECT *, row_number() OVER (PARTITION BY import_batch_id ORDER BY place) AS n FROM ({_FILE_LINES})) AS l JOIN ({_HEADED}) AS h ON h.import_batch_id = l.import_batch_id GROUP BY l.import_batch_id""", stored=True)
def _(e):
    lines = _lines(e)
    marks = staged(csv_files.detect_delimiters(lines), "delimiters")
    return _batch(csv_files.file_profiles(lines, marks, csv_files.detect_headers(lines, marks)))


_DL = "regexp_matches(value, '^[ \\t]*(\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}/\\d{1,2}/\\d{2,4}|\\d{1,2}-\\d{1,2}-\\d{2,4})')"


@query("s08_column_profiles", "import_batch_id bigint, name string, type string, filled bigint, samples string",
       f"""SELECT import_batch_id, name, CASE WHEN count(*) FILTER (WHERE n <= 20 AND num) / least(count(*), 20) > 0.8 THEN 'numeric'
           WHEN count(*) FILTER (WHERE n <= 20 AND NOT num AND dat) / least(count(*), 20) > 0.6 THEN 'date' ELSE 'text' END AS type, count(*) AS filled,
           string_agg(value, '|' ORDER BY n) FILTER (WHERE n <= 5) AS samples
           FROM (SELECT *, row_number() OVER (PARTITION BY import_batch_id, name ORDER BY row_number) AS n, {sql_numeric_text('value')} AS num, {_DL} AS dat
           FROM (SELECT import_batch_id, row_number, name, trim(value) AS value FROM (UNPIVOT (SELECT import_batch_id, row_number, {', '.join(FIELDS)} FROM import_rows) ON {', '.join(FIELDS)} INTO NAME name VALUE value) WHERE trim(value) <> '')) GROUP BY ALL""")
def _(e):
    return csv_files.column_profiles(e.import_rows, ["import_batch_id"], "row_number", FIELDS).withColumnRenamed("column", "name")


# --- content checks -------------------------------------------------------------------------


def _texts(e):
    docs = e.raw("documents").select(F.concat(F.lit("doc-"), "doc_id").alias("item"), "text")
    return docs.unionByName(e.raw("pages").select(F.concat(F.lit("page-"), "page_id").alias("item"), c("html").alias("text")))


_TEXTS = "SELECT 'doc-' || doc_id AS item, text FROM documents UNION ALL SELECT 'page-' || page_id, html FROM pages"
_HITS = " UNION ALL ".join(f"SELECT item, {i} AS pattern_id FROM texts WHERE regexp_matches(text, '{p}', 'im')" for i, p in enumerate(files.SUSPICIOUS, 1))


@query("v20_suspicious_content", "item string, pattern_id int", f"WITH texts AS ({_TEXTS}) {_HITS}")
def _(e):
    return files.suspicious(_texts(e), "item", "text")


_RULES = [
    ("length(html) = 0", "empty"), ("strlen(html) > 52428800", "too_large"), ("url = '' OR length(url) > 255", "invalid_name"),
    ("lower(regexp_extract(url, '\\.([^./]+)$', 1)) NOT IN ('csv', 'txt')", "extension"),
    *[(f"regexp_matches(url, '{p}', 'i')", f"name_pattern_{i}") for i, p in enumerate(files.BAD_NAMES, 1)],
    ("len(string_split(html, chr(10))) > 50000", "too_many_lines"), ("len(list_filter(string_split(html, chr(10)), lambda x: length(x) > 100000)) > 0", "line_too_long"),
    ("trim(string_split(html, chr(10))[1]) <> '' AND NOT regexp_matches(string_split(html, chr(10))[1], '[,\\t|;]')", "no_delimiter"),
]


@query("v21_file_rules", "page_id bigint, rule string", " UNION ALL ".join(f"SELECT page_id, '{r}' AS rule FROM pages WHERE {w}" for w, r in _RULES))
def _(e):
    return files.file_rules(e.raw("pages"), "page_id", "url", "html")


@query("v22_byte_entropy", "doc_id bigint, entropy double, high boolean",
       f"""SELECT doc_id, {sql_round('log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n)', 4)} AS entropy, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n) > 7.5 AS high
           FROM (SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY ALL) GROUP BY doc_id""")
def _(e):
    return files.byte_entropy(e.raw("documents"), "doc_id", "text")


@query("d05_equal_content", "content_hash string, doc_id bigint, copies bigint", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(e):
    return files.equal_content(e.raw("documents"), "doc_id", "text")


# --- written outputs ---------------------------------------------------------------------------


def write_results(results, path: str, batch: str) -> None:
    """Results and audit rows of a batch; running the batch again replaces its partition."""
    from ledgerlink.operators import names

    out = results.withColumn("batch", F.lit(batch))
    audit = out.select("invoice_id", F.lit("match_created").alias("event_type"), names.audit_hash(
        invoice_id=c("invoice_id"), po_id=c("po_id"), confidence=c("confidence"), status=c("match_status")).alias("event_hash"), "batch")
    for label, df in (("results", out), ("audit", audit)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC).partitionBy("batch").parquet(f"{path}/{label}")


@query("k01_results_and_audit", "invoice_id bigint, po_id bigint, match_status string, audited boolean",
       f"SELECT invoice_id, po_id, match_status, TRUE AS audited FROM ({_BANDRUN})", stored=True)
def _(e):
    from ledgerlink.session import staged

    path = scratch_path(e.spark, "match-results")
    run = staged(match.band_run(e.invoices.filter("matching_status = 'unmatched'"), e.purchase_orders, e.receipts, e.vendors), "band-run")
    write_results(run, path, "b1")
    write_results(run, path, "b1")
    audit = e.spark.read.parquet(f"{path}/audit").groupBy("invoice_id").agg((F.count("*") == 1).alias("audited"))
    return e.spark.read.parquet(f"{path}/results").join(audit, "invoice_id", "left")


@query("k05_daily_report_csv", _DCOLS, _DAILY)
def _(e):
    path = scratch_path(e.spark, "daily-report")
    daily = report.daily_metrics(e.spark, e.match_results, e.match_exceptions, "2023-12-30", "2024-02-05")
    daily.orderBy("day").write.option("header", True).csv(path)
    return e.spark.read.option("header", True).schema(_DCOLS).csv(path)
