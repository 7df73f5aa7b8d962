"""Hash-linked audit logs: sealing, and naming every broken record with its reason.

Each record holds the digest of its own fields and the digest of the record before it in the chain
of its key. Neither needs a walk along the chain: a digest depends on its own row alone, and the
record before comes from the same time block or, for the first row of a block, from a table with
one row per (key, block). A key with a third of all records is so dealt over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.operators.names import audit_hash

c = F.col


def with_previous(df: DataFrame, key: str, order: Sequence[str], block: Column, value: str, name: str) -> DataFrame:
    """``value`` of the key's record before, in ``order``; null for its first. ``block`` must not
    fall along the order."""
    rows = df.withColumn("_block", block)
    inside = W.partitionBy(key, "_block").orderBy(*order)
    first = F.row_number().over(inside) == 1
    last = rows.groupBy(key, "_block").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = last.select(key, "_block", F.lag("_last").over(W.partitionBy(key).orderBy("_block")).alias("_before"))
    inner = rows.withColumn("_inside", F.lag(value).over(inside)).withColumn("_first", first)
    return inner.join(before, [key, "_block"]).withColumn(name, F.when(c("_first"), c("_before")).otherwise(c("_inside"))).drop("_block", "_before", "_inside", "_first")


def record_hash(fields: Sequence[str]) -> Column:
    """Digest of the named fields; a null field is left out of it."""
    return audit_hash(**{f: c(f) for f in fields})


def sealed(records: DataFrame, key: str, order: Sequence[str], block: Column, fields: Sequence[str]) -> DataFrame:
    """``records`` with ``record_hash`` and ``previous_record_hash``."""
    return with_previous(records.withColumn("record_hash", record_hash(fields)), key, order, block, "record_hash", "previous_record_hash")


def heads(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, head, records): digest of the newest record and length of each chain, to be kept
    apart from the log."""
    return log.groupBy(key).agg(F.max_by("record_hash", F.struct(*order)).alias("head"), F.count("*").alias("records"))


def broken_records(log: DataFrame, known_heads: DataFrame, key: str, record: str, order: Sequence[str], block: Column, fields: Sequence[str]) -> DataFrame:
    """(key, record, reason) of every record that does not hold, a row per reason.

    ``content``: its fields do not give its digest. ``order``: the digest it names as the one before
    it is that of another record of the chain. ``predecessor``: no record of the chain has the
    digest it names, so the one before it was removed or written anew. ``tail``: it is the newest,
    but not the head that was kept, so newer ones were removed.
    """
    linked = with_previous(log, key, order, block, "record_hash", "_found")
    flags = linked.select(
        key, record, "record_hash", "previous_record_hash", (record_hash(fields) != c("record_hash")).alias("_edited"),
        (~c("previous_record_hash").eqNullSafe(c("_found"))).alias("_loose"))
    content = flags.filter("_edited").select(key, record, F.lit("content").alias("reason"))
    loose = flags.filter("_loose").select(key, record, "previous_record_hash")
    hashes = log.select(c(key).alias("_key"), c("record_hash").alias("_hash")).distinct()
    named = loose.join(hashes, (c(key) == c("_key")) & (c("previous_record_hash") == c("_hash")), "left")
    links = named.select(key, record, F.when(c("_hash").isNotNull() | c("previous_record_hash").isNull(), "order").otherwise("predecessor").alias("reason"))
    newest = log.groupBy(key).agg(F.max_by(F.struct(record, "record_hash"), F.struct(*order)).alias("_top"))
    tails = newest.join(known_heads, key).filter(c("_top.record_hash") != c("head")).select(key, c(f"_top.{record}").alias(record), F.lit("tail").alias("reason"))
    return content.unionByName(links).unionByName(tails)


def chain_status(log: DataFrame, broken: DataFrame, known_heads: DataFrame, key: str) -> DataFrame:
    """Per chain: records found and sealed, records whose content holds, broken links, status."""
    reason = c("reason")
    found = log.groupBy(key).agg(F.count("*").alias("total_records"))
    bad = broken.groupBy(key).agg(
        F.count_if(reason == "content").alias("tampered"), F.count_if(reason.isin("order", "predecessor")).alias("broken_links"), F.count_if(reason == "tail").alias("cut_tails"))
    joined = known_heads.join(found, key, "left").join(bad, key, "left").fillna(0, ["total_records", "tampered", "broken_links", "cut_tails"])
    whole = (c("tampered") + c("broken_links") + c("cut_tails") == 0) & (c("total_records") == c("records"))
    return joined.select(
        key, c("records").alias("sealed_records"), "total_records", (c("total_records") - c("tampered")).alias("verified_records"), "tampered", "broken_links", "cut_tails",
        F.when(whole, "VERIFIED_INTACT").otherwise("INTEGRITY_COMPROMISED").alias("verification_status"))


# The fields of each table's new values that a change view shows; other tables show all.
KEY_FIELDS = {"invoices": ("invoice_number", "amount", "status"), "match_results": ("confidence_score", "status")}


def change_view(events: DataFrame, users: DataFrame) -> DataFrame:
    """Change events with the e-mail of who made them and the key fields of the new values, as JSON
    text."""
    shown = c("new_values")
    for table, fields in KEY_FIELDS.items():
        picked = F.to_json(F.struct(*(F.get_json_object("new_values", f"$.{f}").alias(f) for f in fields)))
        shown = F.when(c("table_name") == table, picked).otherwise(shown)
    names = users.select(c("user_id").alias("changed_by"), c("email").alias("changed_by_email"))
    return events.join(names, "changed_by", "left").withColumn("key_changes", shown)
