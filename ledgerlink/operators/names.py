"""Set-at-a-time work on names, codes, permissions and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.functions.numeric import round_half_up
from ledgerlink.functions.text import vendor_code_base

c = F.col


def suggest_fields(headers: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule (by order) with a keyword contained in the header; null when none."""
    hits = headers.join(F.broadcast(rules), F.contains(c("header"), c("keyword")), "left")
    return hits.groupBy("header").agg(F.min_by("field", "rule_order").alias("field"))


def assign_vendor_codes(vendors: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Codes per tenant: the base for the first name, four letters and a counter for the rest.

    The counter runs over all names sharing the four letters, so two bases with the same
    start cannot produce the same code. ``taken`` holds (tenant_id, vendor_code) in use:
    counters continue behind the highest one and used bases are not given out again.
    """
    based = vendors.withColumn("base", vendor_code_base(c("vendor_name"))).withColumn("stem", F.substring("base", 1, 4))
    numbered = ranked(based, ["tenant_id", "base"], "vendor_name", "n")
    if taken is None:
        numbered = numbered.withColumn("first", c("n") == 1).withColumn("used", F.lit(1))
    else:
        bases = taken.select("tenant_id", c("vendor_code").alias("base"), F.lit(True).alias("gone"))
        tail = F.regexp_extract("vendor_code", "^.{4}([0-9]{2,})$", 1).try_cast("bigint")
        highest = taken.groupBy("tenant_id", F.substring("vendor_code", 1, 4).alias("stem")).agg(
            F.coalesce(F.max(tail), F.lit(1)).alias("used"))
        numbered = (numbered.join(bases, ["tenant_id", "base"], "left").join(highest, ["tenant_id", "stem"], "left")
                    .withColumn("first", (c("n") == 1) & c("gone").isNull())
                    .withColumn("used", F.coalesce("used", F.lit(1))).drop("gone"))
    firsts = numbered.filter("first").select("tenant_id", "vendor_name", c("base").alias("vendor_code"))
    counter = ranked(numbered.filter("not first"), ["tenant_id", "stem"], "vendor_name", "k")
    digits = (c("k") + c("used")).cast("string")
    suffix = F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
    return firsts.unionByName(counter.select("tenant_id", "vendor_name", F.concat("stem", suffix).alias("vendor_code")))


def ranked(df: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
    """1-based position of each row within ``keys``, in the order of (hash block, text).

    The order only has to be fixed, so rows are spread over 4096 blocks by a hash of the
    text: a hot key is sorted in many tasks, and block offsets come from a small count table.
    """
    blocked = df.withColumn("_block", F.substring(F.md5(text), 1, 3))
    inside = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(text))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    return (blocked.withColumn("_inside", inside).join(offsets, [*keys, "_block"])
            .withColumn(name, c("_before") + c("_inside")).drop("_block", "_before", "_inside"))


def explain_match(confidence: Column, vendor: Column, amount: Column, date: Column, reference: Column,
                  share: Column, gap: Column) -> Column:
    def pct(x: Column) -> Column:
        return F.concat((F.floor(x * 1000.0 + 0.5).cast("double") / 10.0).cast("decimal(12,1)").cast("string"), F.lit("%"))

    # The sentences of an explanation.
    fuzzy = F.concat_ws(
        "; ",
        F.concat(F.lit("Fuzzy match with confidence "), pct(confidence)),
        F.concat(F.lit("Vendor similarity: "), pct(vendor)),
        F.concat(F.lit("Amount matching: "), pct(amount)),
        F.concat(F.lit("Date matching: "), pct(date)),
        F.concat(F.lit("Reference matching: "), pct(reference)),
        F.concat(F.lit("Amount variance: "), pct(share)),
        F.concat(F.lit("Date variance: "), gap.cast("string"), F.lit(" days")),
    )
    return F.when(confidence == 1.0, F.lit("Exact match found on PO number, vendor, and amount")).otherwise(fuzzy)


def audit_hash(**fields: Column) -> Column:
    """SHA-256 over JSON text of the fields in name order, every value as a string."""
    ordered = [fields[k].cast("string").alias(k) for k in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def permission_strings(roles: DataFrame) -> DataFrame:
    """(role_id, "resource:action") rows out of each role's JSON permissions."""
    parsed = roles.select("role_id", F.from_json("permissions", "map<string,array<string>>").alias("p"))
    return parsed.select("role_id", F.explode("p").alias("resource", "actions")).select(
        "role_id", "resource", F.explode("actions").alias("action")
    ).select("role_id", F.concat_ws(":", "resource", "action").alias("permission"))


def trusted_device(devices: Column, fingerprint: Column, as_of: Column) -> Column:
    known = F.exists(devices, lambda d: (d["fingerprint"] == fingerprint) & (d["expires_at"] > as_of))
    return F.coalesce(known, F.lit(False))


# --- character n-gram vectors ----------------------------------------------------------


def word_grams(text: Column) -> Column:
    """Character 2- and 3-grams of each word padded with one blank on both sides."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"[ \t\r\n]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def cut(n: int):
        return lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))),
                                     lambda i: F.substr(w, i, F.lit(n)))

    return F.concat(F.flatten(F.transform(padded, cut(2))), F.flatten(F.transform(padded, cut(3))))


def _vectors(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unit-length weight per (tenant, text, gram) over the given vocabulary."""
    counts = texts.select("tenant_id", "text", F.explode(word_grams(c("text"))).alias("gram")).groupBy(
        "tenant_id", "text", "gram").agg(F.count("*").alias("tf"))
    weighted = counts.join(vocabulary, ["tenant_id", "gram"]).withColumn("w", c("tf") * c("idf"))
    norms = weighted.groupBy("tenant_id", "text").agg(F.sqrt(F.sum(c("w") * c("w"))).alias("norm"))
    return weighted.join(norms, ["tenant_id", "text"]).select(
        "tenant_id", "text", "gram", "df", (c("w") / c("norm")).alias("w"))


def tfidf_match(pairs: DataFrame, corpus: DataFrame, features: int | None = None, texts_per_task: int = 200) -> DataFrame:
    """Cosine of (text, candidate) when no other corpus entry is closer to the text, else 0.

    All grams count unless ``features`` names how many of the most frequent ones to use.

    A rival closer than the pair's own cosine must share one of the text's rare grams: the
    grams are walked from rare to common and stop as soon as the weight left over is too
    small to reach that cosine. Only those rare grams are joined to the corpus.
    """
    # Numbers of tasks are given so that adaptive execution does not merge texts, which are few bytes, into
    # one task: there each becomes its grams and all rivals that share one.
    least = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = corpus.select("tenant_id", F.lower(F.trim("name")).alias("text")).distinct().repartition(least, "tenant_id", "text")
    wanted = pairs.select("tenant_id", F.lower(F.trim("text")).alias("text"), F.lower(F.trim("candidate")).alias("candidate")).distinct()
    wanted = wanted.repartition(max(least, -(-wanted.count() // texts_per_task)), "tenant_id", "text")
    sizes = entries.groupBy("tenant_id").agg(F.count("*").alias("n"))
    grams = entries.select("tenant_id", "text", F.explode(word_grams(c("text"))).alias("gram"))
    terms = grams.groupBy("tenant_id", "gram", "text").agg(F.count("*").alias("tf")).groupBy("tenant_id", "gram").agg(
        F.sum("tf").alias("tf"), F.count("*").alias("df"))
    best = W.partitionBy("tenant_id").orderBy(F.desc("tf"), "gram")
    used = terms if features is None else terms.withColumn("rank", F.row_number().over(best)).filter(c("rank") <= features)
    vocabulary = (used.join(sizes, "tenant_id")
                  .select("tenant_id", "gram", "df", (F.log((c("n") + 1) / (c("df") + 1)) + 1.0).alias("idf")))
    entry_vec = _vectors(entries, vocabulary)
    text_vec = _vectors(wanted.select("tenant_id", "text").distinct(), vocabulary)
    own = (wanted.join(text_vec.select("tenant_id", "text", "gram", "w"), ["tenant_id", "text"])
           .join(entry_vec.select("tenant_id", c("text").alias("candidate"), "gram", c("w").alias("v")), ["tenant_id", "candidate", "gram"])
           .groupBy("tenant_id", "text", "candidate").agg(F.sum(c("w") * c("v")).alias("cosine")))
    walk = W.partitionBy("tenant_id", "text", "candidate").orderBy(F.desc("df"), F.desc("gram"))
    rare = (own.join(text_vec, ["tenant_id", "text"])
            .withColumn("rest", F.sqrt(F.sum(c("w") * c("w")).over(walk.rowsBetween(W.unboundedPreceding, 0))))
            .filter(c("rest") >= c("cosine") - 1e-9))
    rivals = (rare.select("tenant_id", "text", "candidate", "cosine", "gram")
              .join(entry_vec.select("tenant_id", c("text").alias("rival"), "gram"), ["tenant_id", "gram"])
              .filter(c("rival") != c("candidate"))
              .select("tenant_id", "text", "candidate", "cosine", "rival").distinct())
    closer = (rivals.join(text_vec.select("tenant_id", "text", "gram", "w"), ["tenant_id", "text"])
              .join(entry_vec.select("tenant_id", c("text").alias("rival"), "gram", c("w").alias("v")), ["tenant_id", "rival", "gram"])
              .groupBy("tenant_id", "text", "candidate", "rival").agg(F.sum(c("w") * c("v")).alias("other"), F.first("cosine").alias("cosine"))
              .filter(c("other") > c("cosine") + 1e-9).select("tenant_id", "text", "candidate").distinct()
              .withColumn("beaten", F.lit(True)))
    return (wanted.join(own, ["tenant_id", "text", "candidate"], "left").join(closer, ["tenant_id", "text", "candidate"], "left")
            .select("tenant_id", "text", "candidate",
                    F.when(c("beaten") | c("cosine").isNull(), 0.0).otherwise(round_half_up(c("cosine"), 6)).alias("score")))


# --- best vendor for a scanned name -------------------------------------------------------


def best_vendor(texts: DataFrame, vendors: DataFrame, asked_block: int = 256, stored_block: int = 2048) -> DataFrame:
    """(tenant_id, text, best_match, score): closest stored name over the text's OCR variants.

    A variant equal to a stored name scores 1.0, which nothing can beat, so those texts are
    settled by a hash join. The rest meets every stored name of its tenant, block by block:
    each pair is bounded by the characters and words it shares, and only pairs whose bound
    reaches the best score so far are scored. Where nothing scores, the match is empty with 0.
    """
    from ledgerlink.functions import fuzzy

    asked = texts.select("tenant_id", "text").distinct()
    stored = (vendors.filter(c("name").isNotNull() & (c("name") != "")).select("tenant_id", c("name").alias("candidate")).distinct()
              .withColumn("key", F.lower(F.trim("candidate"))))
    variants = asked.filter(c("text").isNotNull() & (c("text") != "")).select(
        "tenant_id", "text", F.explode(fuzzy.ocr_variants(c("text"))).alias("variant")).withColumn("key", F.lower(F.trim("variant")))
    settled = variants.join(stored, ["tenant_id", "key"]).groupBy("tenant_id", "text").agg(F.min("candidate").alias("best_match")).withColumn("score", F.lit(1.0))
    rest = variants.join(settled, ["tenant_id", "text"], "left_anti").groupBy("tenant_id", "text").agg(F.collect_set("key").alias("keys"))

    def blocks(rows: DataFrame, of: int, name: str) -> DataFrame:
        return rows.groupBy("tenant_id").agg(F.ceil(F.count("*") / of).alias(name))

    def dealt(rows: DataFrame, text: str, own: str, other: str) -> DataFrame:
        return (rows.join(counts, "tenant_id").withColumn(own, F.pmod(F.xxhash64(text), c(f"{own}s")))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), c(f"{other}s") - 1))).drop(f"{own}s", f"{other}s"))

    counts = blocks(rest, asked_block, "asked_blocks").join(blocks(stored, stored_block, "stored_blocks"), "tenant_id")
    keys = ["tenant_id", "asked_block", "stored_block"]
    # The number is given so that adaptive execution does not merge these small but long tasks.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = dealt(rest, "text", "asked_block", "stored_block").repartition(tasks, *keys)
    right = dealt(stored, "candidate", "stored_block", "asked_block").repartition(tasks, *keys)
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fuzzy.best_in_block, fuzzy.BLOCK_SCHEMA)
    best = met.groupBy("tenant_id", "text").agg(F.min(F.struct((-c("score")).alias("k"), c("best_match"))).alias("b")).select(
        "tenant_id", "text", c("b.best_match").alias("best_match"), round_half_up(-c("b.k"), 6).alias("score"))
    found = settled.unionByName(best).select(c("tenant_id").alias("tenant"), c("text").alias("found"), "best_match", "score")
    return asked.join(found, c("tenant_id").eqNullSafe(c("tenant")) & (c("text") == c("found")), "left").select(
        "tenant_id", "text", F.coalesce("best_match", F.lit("")).alias("best_match"), F.coalesce("score", F.lit(0.0)).alias("score"))
