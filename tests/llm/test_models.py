"""Trained operators on held-out rows, archives on damaged files, the index against brute force."""

import io
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ledgerlink.llm import boosting, components, main_text, multi_index, toxic_crf, warc
from ledgerlink.llm.queries import QUERIES


def test_toxic_spans():
    rng = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnprst"]

    def text(toxic):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(2, 4) * toxic):
            words[rng.randrange(len(words))] = rng.choice(["Zork!", "zorking,", "glim", "GLIM."])
        return " ".join(words)

    labels = np.array([k % 5 == 0 for k in range(800)], np.int64)
    sample = [text(t) for t in labels.tolist()]
    model = toxic_crf.train(sample[:600], labels[:600])
    import pyarrow as pa

    from ledgerlink.llm import text_arrays as ta

    scores = []
    for _, t in ta.slices(pa.RecordBatch.from_pydict({"text": sample[600:] + ["", "zork"]}), lower=True):
        odds = toxic_crf.marginal_odds(model.potentials(toxic_crf.word_features(t), t.doc), t.n_words, model.moves)
        scores += (toxic_crf.summaries(odds, t.doc, t.docs) @ model.logistic > 0).tolist()
    assert np.mean(np.array(scores[:200]) == labels[600:]) > 0.97 and scores[200:] == [False, True]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    potentials, moves = rng.normal(0, 2, 9), rng.normal(0, 1, (2, 2))
    found = toxic_crf.marginal_odds(potentials, np.array([4, 0, 5]), moves)
    for start, n in ((0, 4), (4, 5)):
        totals = np.zeros((n, 2))
        for code in range(2**n):
            states = [code >> k & 1 for k in range(n)]
            weight = np.exp(sum(p for p, s in zip(potentials[start:start + n], states) if s) + sum(moves[a, b] for a, b in zip(states, states[1:])))
            for k, s in enumerate(states):
                totals[k, s] += weight
        assert np.allclose(found[start:start + n], np.log(totals[:, 1] / totals[:, 0]))


def test_long_toxic_documents_are_learned_from(spark):
    rng = random.Random(4)

    def text(toxic):
        words = [f"plain{rng.randrange(300)}" for _ in range(1_500)]
        for at in range(20 if toxic else 1_500, 1_500, 40):
            words[at] = "vileword"
        return " ".join(words)

    rows = [(i, text(i % 2), i % 2) for i in range(60)]
    assert min(len(t) for _, t, _ in rows) > toxic_crf.SAMPLE_CHARS
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 40], "doc_id long, toxic int")
    texts, toxic = toxic_crf.sample(docs, labels)
    assert sorted(toxic.tolist()) == [0] * 20 + [1] * 20 and max(map(len, texts)) <= toxic_crf.SAMPLE_CHARS
    got = {r.doc_id: r for r in toxic_crf.scored(docs, labels).collect()}
    for i, whole, label in rows:
        assert (got[i].score > 0.5) == bool(label), i
        assert {whole[s.start:s.end] for s in got[i].spans} == ({"vileword"} if label else set()), i


def test_held_out_toxicity(spark, sf_dir):
    """The smallest tables hold a handful of toxic labels, so this one reads larger ones."""
    folder = sf_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op3_toxic_spans"](spark, folder).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.85


def test_boosting_learns_interactions():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, (3000, 5))
    y = ((x[:, 0] >= 4) ^ (x[:, 3] >= 5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert np.mean((model.logits(x[2000:]) > 0) == y[2000:]) > 0.97


def test_main_text_of_variants():
    rng = np.random.default_rng(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "porta", "vita", "nunc"]

    def sentence():
        return " ".join(rng.choice(words, 9)).capitalize() + "."

    def page(body):
        return f"<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>Other</a></li></ul></nav>{body}<footer>&copy; site</footer></body></html>"

    def article():
        return "<article><h1>Head line here</h1>" + "".join(f"<p>{sentence()} <b>{sentence()}</b> {sentence()}</p>" for _ in range(5)) + "</article>"

    model = main_text.train([page(article()) for _ in range(60)])
    inner = "<h2>Head</h2>" + "".join(f"<p>{sentence()} <a href='#'>link</a> &amp; {sentence()}</p>" for _ in range(4))
    plain = " ".join(main_text.read(inner).runs and "".join(t for _, t, _ in main_text.read(inner).runs).split())
    source = page(f"<div class='cookie-notice'><p>{sentence()}</p></div><div class='content'>{inner}</div><aside class='sidebar'><p>{sentence()}</p></aside>"
                  f"<div id='comments'><p>{sentence()}</p></div><form><label>Mail</label></form><script>var a='<p>';</script>")
    found = main_text.extract([source, "", None, "<p>&lt;a&gt;  b"], model)
    assert found[0] == plain and found[1:3] == ["", ""]
    assert main_text.extract([source], None) == [plain]


def test_kept_nodes_never_lie_below_dropped_ones():
    page = main_text.read("<div><section><p>a</p><p>b</p></section><ul><li>c</li></ul></div>")
    rng = np.random.default_rng(4)
    for _ in range(50):
        chosen = main_text.decode(page.nodes, rng.normal(0, 3, len(page.nodes)), np.ones(len(page.nodes)))
        assert all(chosen[n.parent] for k, n in enumerate(page.nodes) if k and chosen[k])


def archive(tmp_path, records):
    writer = warc.ArchiveWriter(str(tmp_path))
    for k, payload in enumerate(records):
        writer.add(warc.page_record(k, "http://a/", __import__("hashlib").sha1(payload).hexdigest(), None, payload))
    writer.close()
    return open(writer.path, "rb").read()


def test_archives_have_a_dictionary_and_a_frame_per_record(tmp_path):
    rng = random.Random(1)
    pages = [f"<p>{' '.join(rng.choice(['lorem', 'ipsum', 'dolor', 'sit', 'amet']) + str(rng.randint(0, 99)) for _ in range(60))}</p>".encode() for _ in range(4000)]
    data = archive(tmp_path, pages)
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
    records = [warc.parse_record(r) for r in warc.frames(io.BytesIO(data))]
    assert len(records) == 4001 and records[0][0]["warc-type"] == "warcinfo"
    assert warc.page_row(*records[7])[:3] == (6, "response", len(pages[6])) and warc.page_row(*records[7])[5] == pages[6]


def test_damaged_archives_raise(tmp_path):
    data = archive(tmp_path, [f"<p>{'text ' * 40}{k}</p>".encode() for k in range(4000)])
    for broken in (data[:-3], data[:100], data[:len(data) // 2] + b"?" + data[len(data) // 2 + 1:], b"xx" + data):
        with pytest.raises(warc.ArchiveError):
            for record in warc.frames(io.BytesIO(broken)):
                warc.parse_record(record)
    whole = warc.page_record(1, None, "0" * 40, None, b"abc")
    with pytest.raises(warc.ArchiveError, match="digest"):
        warc.page_row(*warc.parse_record(whole))
    for change in (lambda r: r[:-1], lambda r: r.replace(b"WARC/1.1", b"WARC/9"), lambda r: r.replace(b"WARC-Date", b"X-Date"), lambda r: r.replace(b"abc", b"abd"), lambda r: r + r):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(change(whole))


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(200, 200 + k) for k in range(1, 300)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)]
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert found == {a: root(a) for a in parent}


def test_index_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((80, 24))
    x = np.repeat(centres, 8, axis=0) + rng.standard_normal((640, 24)) * 0.25
    x = np.concatenate([x, rng.standard_normal((600, 24))])
    rows = [(k, [float(np.float32(v)) for v in row]) for k, row in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in multi_index.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = multi_index.units(np.array([r[1] for r in rows]).astype(np.float32).astype(float))
    true = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([got[k] for k in range(len(rows))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum() > 100


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for number, (name, function) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage(function(spark, docs, sf_dir), name)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name in ("quality_rules", "near_copies"):
            assert 0 < docs.count() < before
            before = docs.count()
    assert docs.count() > 0 and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_decoding_against_enumeration():
    """The best choice of nodes that keeps nothing below a dropped node, on small trees."""
    from ledgerlink.llm import dom, main_text

    rng = np.random.default_rng(12)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        parents = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        nodes = [dom.Node("", p, 0, 0, {}) for p in parents]
        logits, weights = rng.normal(0, 2, n), rng.uniform(0.05, 3, n)

        def value(kept):
            return sum(-np.logaddexp(0, -x) * w if k else -np.logaddexp(0, x) * w for k, x, w in zip(kept, logits, weights))

        choices = []
        for code in range(2 ** (n - 1)):
            kept = [True] + [bool(code >> k & 1) for k in range(n - 1)]
            if all(not kept[k] or kept[parents[k]] for k in range(1, n)):
                choices.append(value(kept))
        assert abs(value(main_text.decode(nodes, logits, weights).tolist()) - max(choices)) < 1e-9


def test_deep_and_odd_pages():
    import time

    from ledgerlink.llm import dom

    start = time.perf_counter()
    for source in ("<div>x" * 60_000, "<div>" * 60_000 + "</section>x" * 60_000, "<a href=x><div>y" * 60_000):
        assert len(dom.parse(source).nodes) == 60_001
    assert time.perf_counter() - start < 30
    page = dom.parse("<p>a <math><mi>x</mi></math> b <a href=1>l</a> c <object data=d>fallback</object><svg><text>no</text></svg><select><option>no</select> d")
    assert "".join(t for _, t, _ in page.runs).split() == ["a", "x", "b", "l", "c", "fallback", "d"]
    assert [linked for _, t, linked in page.runs if t.strip() in ("l", "c fallback", "c")] == [True, False]


def test_pages_are_taken_by_length(monkeypatch):
    from ledgerlink.llm import main_text

    monkeypatch.setattr(main_text, "CHARS_AT_ONCE", 10)
    monkeypatch.setattr(main_text, "PAGES_AT_ONCE", 3)
    batch = pa.RecordBatch.from_pydict({"html": pa.array(["aaaa", "bbbb", "cccc", None, "d" * 50, "", "", "", "e"])})
    parts = [p.column("html").to_pylist() for p in main_text._together(batch)]
    assert [len(p) for p in parts] == [2, 2, 1, 3, 1] and sum(parts, []) == batch.column("html").to_pylist()
