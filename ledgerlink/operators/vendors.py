"""Import outputs and vendor upkeep: accepted records, error report, duplicates, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.functions.numeric import round_half_up
from ledgerlink.functions.scores import contact_similarity
from ledgerlink.operators import names
from ledgerlink.session import shared_dir, staged

c = F.col
_ROW = ["import_batch_id", "row_number"]


def accepted_records(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(invoices, default lines) of the rows that passed; a line only with a description."""
    good = checked.filter("disposition = 'success'")
    zero = F.lit(0).cast("decimal(18,2)")
    invoices = good.select(
        *_ROW, "tenant_id", "vendor_id", "invoice_number", "vendor_name", "po_reference",
        F.coalesce("subtotal", "total_amount").alias("subtotal"), F.coalesce("tax_amount", zero).alias("tax_amount"),
        "total_amount", "invoice_date", "due_date")
    lines = good.filter(c("description").isNotNull()).select(
        *_ROW, F.lit(1).alias("line_number"), F.substring("description", 1, 500).alias("description"),
        F.lit(1).cast("decimal(15,4)").alias("quantity"), c("total_amount").alias("unit_price"), c("total_amount").alias("line_total"))
    return invoices, lines


# Column titles of the report, in order.
REPORT_TITLES = {
    "row_number": "Row Number", "column_name": "Column Name", "error_type": "Error Type", "error_code": "Error Code", "error_message": "Error Message",
    "severity": "Severity", "raw_value": "Raw Value", "expected_format": "Expected Format", "suggested_fix": "Suggested Fix", "created_at": "Created At",
}


#: Folders that the batches of a table share by hash.
FOLDERS = 64


def write_batches(rows: DataFrame, path: str) -> None:
    """Write rows of import batches below ``path``; batches that are written again are replaced.

    Folders and files grow with the bytes, not with the number of batches: batches share folders.
    A write replaces the folders it has rows for, with the rows of their other batches among them.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("folder", F.pmod(F.hash(c("import_batch_id").cast("bigint")), F.lit(FOLDERS)))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        again = dealt.select(c("folder").alias("_folder"), c("import_batch_id").alias("_batch")).distinct()
        touched = spark.read.schema(dealt.schema).parquet(path).join(again.select("_folder").distinct(), c("folder") == c("_folder"), "left_semi")
        others = touched.join(again, (c("folder") == c("_folder")) & c("import_batch_id").eqNullSafe(c("_batch")), "left_anti")
        dealt = dealt.unionByName(staged(others, "other-batches"))
    (dealt.hint("rebalance", "folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("folder").parquet(path))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_batches`` wrote."""
    return spark.read.parquet(path).drop("folder")


def write_error_report(rows: DataFrame, path: str) -> None:
    """One folder of CSV files per batch, rows in report order within a file."""
    titled = rows.select("import_batch_id", "position", *(c(k).alias(v) for k, v in REPORT_TITLES.items()))
    ordered = titled.repartition("import_batch_id").sortWithinPartitions("import_batch_id", "position").drop("position")
    ordered.write.mode("overwrite").option("header", True).options(**_REPORT_CSV).option("emptyValue", "").partitionBy("import_batch_id").csv(path)


def read_error_report(spark, path: str, like: DataFrame) -> DataFrame:
    """The report's rows; empty cells are empty texts, and positions are counted anew."""
    text = ", ".join(f"`{title}` string" for title in REPORT_TITLES.values())
    scan = spark.read.schema(f"{text}, import_batch_id bigint").option("header", True).options(**_REPORT_CSV).option("multiLine", True).csv(path)
    rows = scan.select("import_batch_id", *(F.coalesce(c(f"`{v}`"), F.lit("")).cast(dict(like.dtypes)[k]).alias(k) for k, v in REPORT_TITLES.items()))
    return positions(rows, "import_batch_id", _REPORT_ORDER, "position")


_REPORT_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_REPORT_ORDER = ["row_number", "error_code", "column_name", "raw_value"]


def error_report(found: DataFrame, created_at: str) -> DataFrame:
    """Findings of every batch in report order, with empty texts for nulls and a position from 1.
    The message is the code in words and the column."""
    words = F.concat(F.substring("code", 1, 1), F.replace(F.lower(F.substring(c("code"), 2, 1000)), F.lit("_"), F.lit(" ")))
    ordered = found.select(
        *_ROW, F.coalesce("field", F.lit("")).alias("column_name"), c("severity").alias("error_type"),
        c("code").alias("error_code"), F.concat(words, F.lit(" ("), F.coalesce("field", F.lit("")), F.lit(")")).alias("error_message"),
        F.lit(created_at).alias("created_at"), "severity", F.coalesce("raw", F.lit("")).alias("raw_value"),
        F.coalesce("expected", F.lit("")).alias("expected_format"), F.coalesce("fix", F.lit("")).alias("suggested_fix"))
    return positions(ordered, "import_batch_id", _REPORT_ORDER, "position")


def positions(df: DataFrame, group: str, order: Sequence[str], name: str, width: int = 4096) -> DataFrame:
    """1-based position in a total order within each group. The first key is a number: rows are
    numbered within blocks of ``width`` values of it, and blocks are offset by the sizes before
    them, so a large group is many tasks."""
    from pyspark.sql.window import Window as W

    rows = df.withColumn("_block", F.floor(c(order[0]) / width))
    sizes = rows.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(group, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(group, "_block").orderBy(*order))
    return rows.withColumn("_inside", inside).join(offsets, [group, "_block"]).withColumn(
        name, c("_before") + c("_inside")).drop("_before", "_inside", "_block")


def get_or_create(accepted: DataFrame) -> DataFrame:
    """Vendors used by accepted rows: the stored id, or ``created`` when there is none."""
    return accepted.groupBy("tenant_id", "vendor_name", "vendor_id").agg(F.count("*").alias("rows_using")).withColumn(
        "created", c("vendor_id").isNull())


def with_new_vendors(accepted: DataFrame, vendors: DataFrame) -> DataFrame:
    """The vendor table extended by newly met names with hashed ids and free codes."""
    used = get_or_create(accepted)
    coded = names.assign_vendor_codes(vendors.select("tenant_id", c("name").alias("vendor_name")))
    stored = vendors.join(coded.withColumnRenamed("vendor_name", "name"), ["tenant_id", "name"], "left")
    fresh = names.assign_vendor_codes(used.filter("created").select("tenant_id", "vendor_name"), coded)
    made = fresh.select("tenant_id", F.xxhash64("tenant_id", "vendor_name").alias("vendor_id"), c("vendor_name").alias("name"), "vendor_code")
    return stored.select("tenant_id", "vendor_id", "name", "vendor_code").unionByName(made)


# --- duplicates ------------------------------------------------------------------------


_CONTACTS = ["normalized_name", "email", "phone", "tax_id"]


def _signed(vendors: DataFrame) -> DataFrame:
    return vendors.select("tenant_id", "vendor_id", *_CONTACTS, F.sha2(F.to_json(F.struct("tenant_id", *_CONTACTS)), 256).alias("sig"))


def _shared_keys(threshold: float) -> list[list[str]]:
    """Key sets, one of which any pair reaching ``threshold`` must share.

    A name adds at most 60 points, an e-mail 20, phone and tax id 10 each. At 80 a pair with
    only 20 contact points needs equal names; with 30 or more it shares the e-mail and one of
    the others. Above 80 the second case remains alone, below 80 names may differ.
    """
    if threshold <= 60:
        raise ValueError("thresholds up to 60 need no shared contact; join on name blocks instead")
    both = [["mail_key", "phone_key"], ["mail_key", "tax_id"]]
    if threshold > 80:
        return both
    if threshold == 80:
        return [*both, ["mail_key", "normalized_name"], ["phone_key", "tax_id", "normalized_name"]]
    return [["mail_key"], *([["phone_key", "tax_id"]] if threshold > 70 else [["phone_key"], ["tax_id"]])]


def signature_pairs(signed: DataFrame, threshold: float) -> DataFrame:
    """(sig_a, sig_b, score) over distinct (name, e-mail, phone, tax id), sig_a <= sig_b.

    A mass of identical copies is one signature and costs one comparison.
    """
    groups = signed.groupBy("sig").agg(F.first("tenant_id").alias("tenant_id"), *[F.first(f, True).alias(f) for f in _CONTACTS])
    groups = groups.withColumn("mail_key", F.lower("email")).withColumn("phone_key", F.regexp_replace("phone", "[^0-9]", ""))
    joined = None
    for shared in _shared_keys(threshold):
        usable = groups.dropna(subset=shared).select("tenant_id", *shared, "sig")
        part = (usable.withColumnRenamed("sig", "sig_a").join(usable.withColumnRenamed("sig", "sig_b"), ["tenant_id", *shared])
                .filter("sig_a <= sig_b").select("sig_a", "sig_b"))
        joined = part if joined is None else joined.unionByName(part)
    sides = [groups.select(c("sig").alias(f"sig_{s}"), *[c(f).alias(f"{f}_{s}") for f in _CONTACTS]) for s in "ab"]
    args = [c(f"{f}_{s}") for f in _CONTACTS for s in "ab"]
    return (joined.distinct().join(sides[0], "sig_a").join(sides[1], "sig_b")
            .select("sig_a", "sig_b", contact_similarity(*args).alias("score")).filter(c("score") >= threshold - 1e-9))


def contact_scores(vendors: DataFrame) -> DataFrame:
    """(vendor_id, other_id, score, renormalized) of the pairs of a tenant that share an e-mail, phone
    or tax id, smaller id first. Vendors meet on the shared value; a value is one vendor's own
    but for its duplicates."""
    keys = F.array_compact(F.array(F.concat(F.lit("m"), F.lower("email")), F.concat(F.lit("p"), F.regexp_replace("phone", "[^0-9]", "")), F.concat(F.lit("t"), c("tax_id"))))
    keyed = vendors.select("tenant_id", "vendor_id", F.explode(keys).alias("key"))
    met = keyed.join(keyed.withColumnRenamed("vendor_id", "other_id"), ["tenant_id", "key"]).filter("vendor_id < other_id").select("vendor_id", "other_id").distinct()
    sides = [vendors.select(c("vendor_id").alias(k), *[c(f).alias(f"{f}_{s}") for f in _CONTACTS]) for k, s in (("vendor_id", "a"), ("other_id", "b"))]
    args = [c(f"{f}_{s}") for f in _CONTACTS for s in "ab"]
    return met.join(sides[0], "vendor_id").join(sides[1], "other_id").select(
        "vendor_id", "other_id", round_half_up(contact_similarity(*args), 4).alias("score"), round_half_up(contact_similarity(*args, renormalize=True), 4).alias("renormalized"))


def duplicate_pairs(vendors: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Vendor pairs (smaller id first) whose contact similarity reaches ``threshold``."""
    signed = _signed(vendors)
    members = signed.select("sig", "vendor_id")
    return (signature_pairs(signed, threshold).join(members.toDF("sig_a", "x"), "sig_a").join(members.toDF("sig_b", "y"), "sig_b")
            .filter((c("sig_a") != c("sig_b")) | (c("x") < c("y")))
            .select(F.least("x", "y").alias("vendor_id"), F.greatest("x", "y").alias("other_id"), "score"))


def duplicate_groups(vendors: DataFrame, spark, threshold: float = 80.0) -> DataFrame:
    """(leader_id, member_id, score): greedy groups, with identical copies handled once.

    Copies of a vendor have its neighbours. If a copy can match anything at all it matches
    its own first copy, so only first copies are clustered and the others follow theirs.
    """
    signed = staged(_signed(vendors), "signed")
    first = signed.groupBy("sig").agg(F.min("vendor_id").alias("rep"))
    near = staged(signature_pairs(signed, threshold), "signature-pairs")
    pairs = (near.filter("sig_a <> sig_b").join(first.toDF("sig_a", "x"), "sig_a").join(first.toDF("sig_b", "y"), "sig_b")
             .select(F.least("x", "y").alias("vendor_id"), F.greatest("x", "y").alias("other_id"), "score"))
    groups = leader_groups(pairs, spark)
    own = near.filter("sig_a = sig_b").select(c("sig_a").alias("sig"), c("score").alias("own"))
    copies = signed.join(first, "sig").join(own, "sig").filter("vendor_id <> rep").select("vendor_id", "rep", "own")
    led = groups.select(c("member_id").alias("rep"), "leader_id", "score")
    follow = copies.join(led, "rep", "left").select(
        F.coalesce("leader_id", "rep").alias("leader_id"), c("vendor_id").alias("member_id"), F.coalesce("score", "own").alias("score"))
    return groups.unionByName(follow)


def leader_groups(pairs: DataFrame, spark, checkpoint_every: int = 2) -> DataFrame:
    """(leader_id, member_id, score): greedy leader clustering in id order.

    A vendor leads when no smaller leader is within the threshold. Each round settles every
    vendor whose smaller neighbours are all settled; lineage is cut by checkpoints in the
    shared folder, so lost executors only cost the last rounds.
    """
    shared_dir(spark)
    edges = pairs.select("vendor_id", "other_id", "score").checkpoint()
    nodes = edges.select("vendor_id").union(edges.select("other_id")).distinct()
    state = nodes.withColumn("role", F.lit("open")).checkpoint()
    done = 0
    while True:
        smaller = edges.join(state.select(c("vendor_id"), c("role").alias("r")), "vendor_id").groupBy(c("other_id").alias("vendor_id")).agg(
            F.max(c("r") == "leader").alias("near_leader"), F.max(c("r") == "open").alias("waits"))
        state = state.join(smaller, "vendor_id", "left").select(
            "vendor_id",
            F.when(c("role") != "open", c("role")).when(c("near_leader"), "member")
            .when(F.coalesce("waits", F.lit(False)), "open").otherwise("leader").alias("role"))
        done += 1
        if done % checkpoint_every == 0:
            state = state.checkpoint()
            if state.filter("role = 'open'").isEmpty():
                break
    leaders = state.filter("role = 'leader'").select("vendor_id")
    members = state.filter("role = 'member'").select(c("vendor_id").alias("other_id"))
    return (edges.join(leaders, "vendor_id").join(members, "other_id").groupBy(c("other_id").alias("member_id"))
            .agg(F.min(F.struct(c("vendor_id"), c("score"))).alias("x"))
            .select(c("x.vendor_id").alias("leader_id"), "member_id", c("x.score").alias("score")))


def review_rows(groups: DataFrame, vendors: DataFrame, auto_merge: bool = True, merge_at: float = 95.0) -> DataFrame:
    name = vendors.select("tenant_id", c("vendor_id").alias("member_id"), c("name").alias("original_name"))
    lead = vendors.select(c("vendor_id").alias("leader_id"), "normalized_name")
    approved = (c("score") >= merge_at) if auto_merge else F.lit(False)
    return groups.join(name, "member_id").join(lead, "leader_id").select(
        "tenant_id", "original_name", "normalized_name", c("score").alias("confidence"), c("leader_id").alias("canonical_vendor_id"),
        c("member_id").alias("duplicate_vendor_id"), F.when(approved, "approved").otherwise("pending").alias("status"))


def resolve_merges(merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, refused) of ``merges`` (duplicate_vendor_id, canonical_vendor_id): every merge with
    the last vendor of its chain, and the merges whose chain runs in a circle.

    Each round joins the map with itself, so distances double and rounds grow with the logarithm of
    the longest chain. When a round settles nothing, what is still open leads into a circle. A
    vendor merged twice takes the smaller target.
    """
    once = staged(merges.groupBy("duplicate_vendor_id").agg(F.min("canonical_vendor_id").alias("canonical_vendor_id")), "merges")
    state = once.withColumn("open", F.lit(True))
    before = -1
    while True:
        via = state.select(c("duplicate_vendor_id").alias("canonical_vendor_id"), c("canonical_vendor_id").alias("_next"), F.lit(True).alias("_on"))
        state = staged(state.join(via, "canonical_vendor_id", "left").select(
            "duplicate_vendor_id", F.coalesce("_next", "canonical_vendor_id").alias("canonical_vendor_id"), F.coalesce("_on", F.lit(False)).alias("open")), "merge-chains")
        left = state.filter("open").count()
        if left in (0, before):
            break
        before = left
    refused = once.join(state.filter("open").select("duplicate_vendor_id"), "duplicate_vendor_id", "left_semi")
    return state.filter("not open").drop("open"), refused


def rewrite_vendor(table: DataFrame, merges: DataFrame) -> DataFrame:
    """Replace merged vendor ids by their canonical id (``merges`` are resolved)."""
    target = merges.select(c("duplicate_vendor_id").alias("vendor_id"), c("canonical_vendor_id").alias("_to"))
    return table.join(target, "vendor_id", "left").withColumn("vendor_id", F.coalesce("_to", "vendor_id")).drop("_to")


def deactivate_merged(vendors: DataFrame, merges: DataFrame) -> DataFrame:
    target = merges.select(c("duplicate_vendor_id").alias("vendor_id"), c("canonical_vendor_id").alias("merged_into"))
    return vendors.join(target, "vendor_id", "left").withColumn("is_active", c("is_active") & c("merged_into").isNull())
