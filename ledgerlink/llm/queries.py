"""The registered queries of this package and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm import (
    byte_bpe, collocations, id_files, infilling, main_text, mixing, multi_index, rules, set_join, sharding, substrings, toxic_crf, warc,
)
from ledgerlink.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@_query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


# The blocks of each source are listed and counted by quotient, ranked by the hash of their number
# and drawn in that order; each document's place is one running sum over its whole source, and its
# words are laid over the drawn blocks.
ORACLE_SQL["op2_source_mix"] = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), caps AS (
    SELECT source, source_size, [5, 2, 1][((place - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM totals
), levels AS (
    SELECT a.source, a.source_size, a.weight, a.cap,
        (SELECT sum(source_size) FROM caps)::BIGINT
            - coalesce((SELECT sum(b.cap) FROM caps b WHERE b.cap / b.weight < a.cap / a.weight), 0)::BIGINT AS rest,
        (SELECT sum(b.weight) FROM caps b WHERE b.cap / b.weight >= a.cap / a.weight)::BIGINT AS shares
    FROM caps a
), opened AS (
    SELECT rest, shares FROM levels WHERE rest * weight <= cap * shares ORDER BY cap / weight LIMIT 1
), targets AS (
    SELECT source, source_size, cap, coalesce(least(cap::DOUBLE, (SELECT rest FROM opened)::DOUBLE * weight / (SELECT shares FROM opened)), 0) AS target FROM caps
), blocks AS (
    SELECT greatest(1, coalesce(floor(min(target) FILTER (target > 0) / 200), 1))::BIGINT AS block FROM targets
), quotas AS (
    SELECT t.source, t.source_size, t.target, block, ceil(t.source_size / block)::BIGINT AS n_blocks,
        (SELECT count(*) FROM range(1, (target / block + 2)::BIGINT) k(i) WHERE t.target / (2 * i - 1) >= block / 2)::BIGINT AS quota
    FROM targets t, blocks
), ranked AS (
    SELECT source, block, n_blocks, quota, number, row_number() OVER (PARTITION BY source ORDER BY md5('mix-1:' || coalesce(source, 'null') || ':' || number), number) - 1 AS rank
    FROM (SELECT *, unnest(range(0, n_blocks)) AS number FROM quotas WHERE quota > 0)
), drawn AS (
    SELECT source, block, number, count(*) AS times FROM ranked, range(0, 4) turns(turn) WHERE turn * n_blocks + rank < quota GROUP BY ALL
), placed AS (
    SELECT s.doc_id, s.size, q.*, row_number() OVER () AS row_no, coalesce(sum(s.size) OVER (
        PARTITION BY s.source ORDER BY md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null')), s.doc_id, s.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
    FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), taken AS (
    SELECT row_no, sum(times * (least(begins + size, (number + 1) * d.block) - greatest(begins, number * d.block)))::BIGINT AS taken
    FROM placed p JOIN drawn d ON d.source IS NOT DISTINCT FROM p.source AND number * d.block < begins + size AND (number + 1) * d.block > begins GROUP BY row_no
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed p LEFT JOIN taken t ON t.row_no = p.row_no
"""


@_query
def op4_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return rules.judged(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode, and digest both sides; the digests are taken by Spark."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@_query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.archived(pages, payloads=False).drop("payload")


ORACLE_SQL["op1_warc_archives"] = """
WITH full_pages AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), sets AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM full_pages
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN dup THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN dup THEN top END AS refers_to
FROM (SELECT *, payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top AS dup FROM sets)
"""


@_query
def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return id_files.filed(docs, public_tokenizers.path("word_bpe_49k.json"))


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents", "doc_id", "text"))


# Each text is cut into words once; windows are joined words; a word goes if one of the up to
# thirteen windows over it starts in an earlier document.
ORACLE_SQL["op8_substring_dedup"] = r"""
WITH split AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS win FROM split, range(1, len(words) - 11) t(i)
), firsts AS (
    SELECT win, min(doc_id) AS first FROM windows GROUP BY win
), hits AS (
    SELECT w.doc_id, w.i FROM windows w JOIN firsts f ON w.win = f.win WHERE f.first < w.doc_id
), gone AS (
    SELECT DISTINCT doc_id, i + k AS place FROM hits, range(0, 13) t(k)
), lost AS (
    SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
)
SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN places IS NULL THEN words
        ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM split s LEFT JOIN lost l ON s.doc_id = l.doc_id
"""


@_query
def op5_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.groups(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@_query
def op3_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of a document follows from its id; labels of the held-out fold are never read."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out)
    return toxic_crf.scored(docs, labels).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@_query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@_query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.infilled(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fim.*")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infilling.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


# The units are a list; parts are slices of it. The restored text is the text.
ORACLE_SQL["op11_fill_in_middle"] = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
        list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, 'null')), k, 8))::BIGINT) AS h
    FROM documents
), formed AS (
    SELECT *, len(units)::BIGINT AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
             WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), cut AS (
    SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
        coalesce(array_to_string(units[b + 1:], ''), '') AS s
    FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
"""

SHARDS = 40


@_query
def op12_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of equal weight; ``grown_shard`` is the shard among forty-one."""
    placed = sharding.sharded(table(spark, sf_dir, "documents", "doc_id", "text"), [1.0] * SHARDS)
    return placed.select("doc.doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# The checksum walks the bytes of each text with the usual table, made here from its polynomial.
ORACLE_SQL["op12_rendezvous_shards"] = r"""
WITH entries AS (
    SELECT list(e ORDER BY b) AS entries FROM (
        SELECT b, list_reduce(list_prepend(b, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e FROM range(0, 256) t(b))
), shards AS (
    SELECT i, (1 + ('0x' || substr(md5('shard:' || i), 1, 8))::BIGINT % 536870912) AS a, (1 + ('0x' || substr(md5('shard:' || i), 9, 8))::BIGINT % 536870912) AS b,
        (1 + ('0x' || substr(md5('shard:' || i), 17, 8))::BIGINT % 536870912) AS c
    FROM range(0, 41) t(i)
), keys AS (
    SELECT DISTINCT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS x, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 9, 8))::BIGINT AS y
    FROM documents
), scores AS (
    SELECT doc_id, i, -ln(((x * a + y * b + c) % 2147483647 + 0.5e0) / 2147483647e0) AS score FROM keys, shards
), won AS (
    SELECT doc_id, arg_min(i, score) FILTER (WHERE i < 40)::INTEGER AS shard, arg_min(i, score)::INTEGER AS grown_shard FROM scores GROUP BY doc_id
), sized AS (
    SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS text_crc32
    FROM documents, entries
)
SELECT s.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM sized s JOIN won w ON w.doc_id IS NOT DISTINCT FROM s.doc_id
"""


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "text", "lang"))


# Every window of every piece is listed and counted; cuts look their parts up in the counts.
ORACLE_SQL["op13_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), split AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (
    SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang
), counts AS (
    SELECT lang, words[i:i + m - 1] AS phrase, count(*)::BIGINT AS f FROM split, range(1, 6) lengths(m), range(1, len(words) - m + 2) starts(i) GROUP BY ALL HAVING count(*) >= 100
), inner_parts AS (
    SELECT lang, phrase[1:len(phrase) - 1] AS part, f FROM counts WHERE len(phrase) > 2 UNION ALL SELECT lang, phrase[2:], f FROM counts WHERE len(phrase) > 2
), kept AS (
    SELECT * FROM counts c WHERE len(phrase) > 1 AND NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = c.lang AND p.part = c.phrase AND p.f >= c.f)
), cuts AS (
    SELECT kept.lang, kept.phrase, kept.f AS a, k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * kept.f * t.n // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM kept, range(1, 5) cut(k), counts l, counts r, totals t
    WHERE k < len(kept.phrase) AND l.lang = kept.lang AND l.phrase = kept.phrase[1:k] AND r.lang = kept.lang AND r.phrase = kept.phrase[k + 1:] AND t.lang = kept.lang
), worst AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, array_to_string(phrase, ' ') AS text FROM worst
)
SELECT lang, rank, text AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, text) AS rank FROM ranked) WHERE rank <= 2000
"""
