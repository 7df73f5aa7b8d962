"""Fill-in-the-middle, shards and collocations against plain versions of themselves."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlink.llm import collocations, infilling, sharding
from ledgerlink.llm import queries as corpus

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXTS = [None, "", "a", " ", "ab cd", "x<P>y", "one two, three!\n" * 20, "ß👍é" * 30, "$1\\2 <", "word " * 1500, "Z" * 5000, "\x00\r\n\t", "<" * 40, "P>S>M>" * 9]


def plain_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    if h[3] % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_infilled(spark):
    rows = [(k * len(TEXTS) + j, t) for k in range(12) for j, t in enumerate(TEXTS)] + [(None, "no id here"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, n string, form int, fim int").repartition(3)
    found = infilling.infilled(docs.drop("fim"))
    assert found.columns == ["doc_id", "text", "n", "form", "fim"]
    got = found.select("doc_id", "fim.n", "fim.form", "fim.output", "fim.prefix_chars", "fim.middle_chars", infilling.restored(F.col("fim.form"), F.col("fim.output")).alias("back"), "text").collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(((i, *plain_infill(i, t)) for i, t in rows), key=repr)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infilled_very_long_text(spark):
    text = "Überall wörter, und 12 zeichen.\n" * 60_000
    got = infilling.infilled(spark.createDataFrame([(5, text)], "doc_id long, text string")).select("fim.*").first()
    assert (got["n"], got["form"], got["output"], got["prefix_chars"], got["middle_chars"]) == plain_infill(5, text)


def test_infilled_empty(spark):
    assert infilling.infilled(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_shard(key, weights):
    digest = hashlib.md5(("null" if key is None else str(key)).encode()).hexdigest()
    x, y = int(digest[:8], 16), int(digest[8:16], 16)
    scores = []
    for i, w in enumerate(weights):
        a, b, c = sharding.factors(i)
        scores.append(-math.log(((x * a + y * b + c) % sharding.PRIME + 0.5) / sharding.PRIME) / w)
    return scores.index(min(scores))


def test_shards_by_weight(spark):
    weights = [1.0, 2.0, 0.5, 4.0, 1.0, 1.5]
    ids = spark.range(60_000).select(F.col("id").alias("k"))
    got = ids.select("k", sharding.shard_of(F.col("k"), weights).alias("s"), sharding.shard_of(F.col("k"), [*weights, 3.0]).alias("g")).collect()
    assert all(r["g"] in (r["s"], 6) for r in got)
    shares, grown = collections.Counter(r["s"] for r in got), collections.Counter(r["g"] for r in got)
    for i, w in enumerate(weights):
        assert abs(shares[i] / 60_000 - w / 10) < 0.01
    assert abs(grown[6] / 60_000 - 3 / 13) < 0.01
    assert all(plain_shard(r["k"], weights) == r["s"] for r in got[:3000])
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("k"), [1.0, 0.0])


def test_forty_shards_are_near_equal(spark):
    counts = [r["count"] for r in spark.range(200_000).select(sharding.shard_of(F.col("id"), [1.0] * 40).alias("s")).groupBy("s").count().collect()]
    assert len(counts) == 40 and sum((n - 5000) ** 2 / 5000 for n in counts) < 80  # chi-square, 39 degrees


def test_shard_files(spark):
    rows = [(i % 500, f"text {i % 7}", "a") for i in range(3000)] + [(None, "same", "b")] * 1500 + [(None, None, "c"), (7, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("slot", F.lit(1)).withColumn("part", F.lit("p"))
    got = sharding.sharded(docs.repartition(7), [1.0, 2.0, 1.0]).select("doc.doc_id", "doc.text", "doc.shard", "size", "text_crc32", F.col("shard").alias("s"), "slot", "grown_shard").collect()
    assert sorted((tuple(r[:3]) for r in got), key=repr) == sorted(rows, key=repr)
    for shard in range(3):
        mine = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got if r["s"] == shard)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    for r in got:
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["s"]) == (len(body) + 16, zlib.crc32(body), plain_shard(r["doc_id"], [1.0, 2.0, 1.0]))
    assert sharding.sharded(docs.limit(0), [1.0, 1.0]).collect() == []


def plain_collocations(docs, threshold, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    kept = {k: v for k, v in f.items() if v >= threshold}

    def covered(lang, phrase, a):
        return any(lang == other[0] and len(other[1]) > len(phrase) and v >= a and any(
            other[1][i:i + len(phrase)] == phrase for i in range(len(other[1]) - len(phrase) + 1)) for other, v in kept.items())

    out = []
    for lang in n:
        rows = []
        for (where, phrase), a in kept.items():
            if where != lang or len(phrase) < 2 or covered(lang, phrase, a):
                continue
            score, k = min((1000 * a * n[lang] // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k) for k in range(1, len(phrase)))
            rows.append((-score, -a, " ".join(phrase).encode(), f[lang, phrase[:k]], f[lang, phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


WORDS = ["The", "the", "a", "ü", "Ü", "b", "x.y", "new", "york", "city", "of", "and", "-", "\x0b", "!", "\n", "\t", "k,l", "　"]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:  # many dictionaries, tries and blocks; buckets that all collide
        monkeypatch.setattr(collocations, "CHUNK_WORDS", 3)
        monkeypatch.setattr(collocations, "TRIE_PHRASES", 4)
        monkeypatch.setattr(collocations, "GROUP_CODES", 50)
        monkeypatch.setattr(collocations, "_bits", lambda windows: 3)
    rng = random.Random(5)
    docs = [(" ".join(rng.choices(WORDS, weights=[9, 9, 9, 3, 3, 3, 2, 6, 6, 6, 5, 5, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    docs += [("new york city hall  park " * 40, "en"), (None, "en"), ("", "zz"), ("lone words", "zz"), ("the the the the the the the the", "de")] * 2
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, key int, word string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(frame, threshold=5, top=25).collect())
    assert got == plain_collocations(docs, 5, 25) and len(got) > 60


def test_collocations_without_any(spark):
    frame = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert collocations.collocations(frame).collect() == [] and collocations.collocations(frame.limit(0)).collect() == []
    assert collocations.collocations(spark.createDataFrame([("a b. " * 200, "en")], "text string, lang string")).select("phrase", "a", "score").collect() == [("a b", 200, 2000)]


def test_scores_pass_64_bits(spark, monkeypatch):
    big = 4 * 10**12
    words = spark.createDataFrame([("en", "a", 1), ("en", "b", 2)], "lang string, word string, code int")
    phrases = spark.createDataFrame([([1], big), ([2], big + 1), ([1, 2], big - 1)], "words array<int>, f long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda docs, threshold: (phrases, words, spark.createDataFrame([("en", 9 * 10**12)], "lang string, n long")))
    row = collocations.collocations(words).first()
    assert row["score"] == 1000 * (big - 1) * 9 * 10**12 // (big * (big + 1))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10**6), st.integers(2, 9))
def test_trie_finds_what_a_dictionary_finds(length, seed, words):
    rng = np.random.default_rng(seed)
    phrases = np.unique(rng.integers(1, words * 100, (rng.integers(1, 80), length)) % (words * 7) + 1, axis=0).astype(np.int32)
    codes = rng.integers(0, words * 7 + 3, 300).astype(np.int32)
    codes[50:50 + length] = phrases[-1]
    trie = collocations.double_array(phrases)
    at, row = collocations.walk(trie, codes)
    known = {tuple(p): k for k, p in enumerate(phrases.tolist())}
    want = [(i, known[tuple(codes[i:i + length].tolist())]) for i in range(300 - length + 1) if tuple(codes[i:i + length].tolist()) in known]
    assert list(zip(at.tolist(), row.tolist())) == want
    assert (50, len(phrases) - 1) in want


def test_queries_on_null_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["n"] for r in corpus.op11_fill_in_middle(spark, str(tmp_path)).orderBy("n").collect()] == [0, 1]
    assert sorted(r["slot"] for r in corpus.op12_rendezvous_shards(spark, str(tmp_path)).collect()) == [0, 1]
