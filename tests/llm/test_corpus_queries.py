"""Queries with a statement against it; all queries on hard rows, empty tables and clashing columns."""

import types

import compare
import pytest
from pyspark.sql import functions as F

from ledgerlink.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_warc_archives": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op2_source_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_toxic_spans": {"doc_id", "held_out", "score", "predicted"},
    "op4_isolation_forest": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5_set_join": {"doc_id", "n_shingles", "component_id"},
    "op6_id_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op7_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op8_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op9_main_text": {"page_id", "url", "text", "n_chars"},
    "op10_multi_index": {"vec_id", "n_links", "component_id", "kept"},
    "op11_fill_in_middle": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
    "op12_rendezvous_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op13_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}
LONG = " ".join(f"w{i}" for i in range(30_000))
DOCS = [(1, "same text here", None, "s", 1), (1, "same text here", None, "s", 1), (2, None, "en", None, 0), (3, "", "en", "s", 0), (None, "no id at all", "en", "t", 3),
        (4, " \t\n", "en", "t", 3), (5, LONG, "en", "t", len(LONG)), (6, LONG, "en", "u", len(LONG)), (7, "über\x0bÄrger\x0c\r\n x", "de", "u", 9)]
PAGES = [(1, None, None), (1, None, None), (None, "http://a/ b\n", "<p>x"), (2, "u", ""), (3, "u", "<article><p>" + LONG + "</article>"), (4, "u", "<article><p>" + LONG + "</article>")]
VECTORS = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], None), (3, [1.0, 0.0], None), (None, [2.0, 0.0], 0), (4, None, 0), (5, [0.0, 0.0], 0),
           (6, [None, 1.0], 0), (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (11, [-1.0, 0.0], 0)]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int", "labels": "doc_id long, quality int, toxic int"}
EXTRA = ["size", "bucket", "first", "hash", "row", "path", "ids", "words", "live", "block", "vec", "digest", "_key1", "_row", "score", "piece", "chosen"]


def folder(spark, path, rows):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        df.select("*", *(F.lit("x").alias(c) for c in EXTRA)).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("hard"), {"documents": DOCS, "pages": PAGES, "embeddings": VECTORS, "labels": [(1, 1, 0), (1, 1, 1), (None, 0, 1), (3, None, None)]})


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_statement(spark, duck, sf_dir, name):
    query = types.SimpleNamespace(run=QUERIES[name], oracle=lambda: ORACLE_SQL[name])
    assert compare.differences(spark, duck, query, sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op13_collocations"}))
def test_one_row_per_row(spark, sf_dir, hard, name):
    for path in (sf_dir, hard):
        found = QUERIES[name](spark, path)
        assert COLUMNS[name] <= set(found.columns)
        source = {"op1": "pages", "op9": "pages", "op10": "embeddings"}.get(name.split("_")[0], "documents")
        rows = spark.read.parquet(f"{path}/{source}.parquet")
        key = rows.columns[0]
        assert sorted(map(str, (r[0] for r in found.select(key).collect()))) == sorted(str(r[0]) for r in rows.select(key).collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_hard_rows(spark, hard):
    def rows(name, *columns):
        return sorted((tuple(r) for r in QUERIES[name](spark, hard).select(*columns).collect()), key=str)

    taken = {r[0]: r for r in rows("op2_source_mix", "doc_id", "size", "taken")}
    assert taken[2][1:] == taken[3][1:] == (0, 0) and taken[5][1] == 30_000
    assert rows("op5_set_join", "doc_id", "n_shingles", "component_id") == sorted([
        (1, 1, 1), (1, 1, 1), (2, 0, 2), (3, 0, 3), (None, 2, None), (4, 0, 4), (5, 29_998, 5), (6, 29_998, 5), (7, 1, 7)], key=str)
    assert {r[:2] for r in rows("op8_substring_dedup", "doc_id", "n_removed")} >= {(5, 0), (6, 30_000), (1, 0), (None, 0)}
    assert rows("op10_multi_index", "vec_id", "n_links", "component_id", "kept") == sorted([
        (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False), *((k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11))], key=str)
    archives = rows("op1_warc_archives", "page_id", "payload_bytes", "record_type", "refers_to")
    assert (3, len(PAGES[4][2]), "revisit", 4) in archives and (4, len(PAGES[4][2]), "response", None) in archives and archives.count((1, 0, "response", None)) == 2
    texts = dict(rows("op9_main_text", "page_id", "text"))
    assert texts[1] == texts[2] == "" and texts[3] == LONG
