"""Text operators against plain versions of themselves."""

import array
import collections
import itertools
import hashlib
import heapq
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlink.llm import byte_bpe, id_files, mixing, rules, set_join, substrings
from ledgerlink.llm import text_arrays as ta
from ledgerlink.llm.queries import bpe_digests
from ledgerlink.llm.tables import filesystem
from ledgerlink.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\x0b\x0c\rab,é 　'sS1#", max_size=40)), max_size=12)
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "é", " ", "　", "!", "\x1c", "the", "👍", "\r\n", "<|endoftext|>"]


def odd_texts(count, seed):
    rng = random.Random(seed)
    return [None, "", " ", "a  ", *("".join(rng.choices(PIECES, k=rng.randint(1, 25))) for _ in range(count))]


def plain_counts(text):
    words = WORD.findall(text or "")
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered)]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_counts(sample):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(sample, pa.string())})
    found = [row for _, t in ta.slices(batch) for row in np.column_stack(list(rules.slice_stats(t).values())).tolist()]
    assert found == [plain_counts(t) for t in sample]


def test_slices_keep_long_texts_whole(monkeypatch):
    monkeypatch.setattr(ta, "SLICE_BYTES", 16)
    sample = ["x " * 50, "a", None, "b c d e f g h i j", "é"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(sample)})
    assert [n for _, t in ta.slices(batch) for n in t.n_words.tolist()] == [50, 1, 0, 9, 1]


def test_slices_hold_little_memory(monkeypatch):
    monkeypatch.setattr(ta, "_powers", [])
    batch = pa.RecordBatch.from_pydict({"text": ["some words of a text " * 50] * 6000})
    tracemalloc.start()
    try:
        words = sum(int(t.n_words.sum()) for _, t in ta.slices(batch))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert words == 5 * 50 * 6000 and peak < 60e6


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (2000, 3)), rng.normal(9, 1, (20, 3))])
    scores = rules.grow(x).scores(x)
    assert scores[2000:].min() > np.quantile(scores[:2000], 0.98)


def test_quotas_are_highest_quotients(spark):
    sizes = [("a", 9000), ("b", 4000), ("c", 350), (None, 20_000)]
    rows = mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()
    targets = {r["source"]: r["target"] for r in rows}
    assert targets["c"] == pytest.approx(1050) and sum(targets.values()) == pytest.approx(33_350)
    quotas = {r["source"]: r["quota"] for r in rows}
    heap = [(-t, s or "", s, 1) for s, t in targets.items()]
    heapq.heapify(heap)
    won = collections.Counter()
    for _ in range(sum(quotas.values())):
        _, _, source, k = heapq.heappop(heap)
        won[source] += 1
        heapq.heappush(heap, (-targets[source] / (2 * k + 1), source or "", source, k + 1))
    assert won == quotas
    shards = mixing.shard_quotas(mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")), 7).collect()
    total = collections.Counter()
    for r in shards:
        assert r["blocks"] >= 0
        total[r["source"]] += r["blocks"]
    assert total == quotas


def test_mix_rows_hold_the_words_taken(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.randint(0, 30))), rng.choice("abcd"), "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = collections.Counter()
    for r in mixing.mixed(docs).collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_draws_fill_the_shards(spark):
    """Each shard holds its quota, a turn draws no block twice, and documents stay below the cap."""
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = mixing.source_targets(docs.select("source", mixing.n_words(docs["text"]).alias("size")))
    draws = [tuple(r) for r in mixing.drawn_blocks(targets, 7).collect()]
    assert len(draws) == len({d[:3] for d in draws})
    quotas = {(r["source"], r["shard"]): r["blocks"] for r in mixing.shard_quotas(targets, 7).collect() if r["blocks"]}
    assert quotas == dict(collections.Counter((d[0], d[3]) for d in draws))
    found = mixing.mix(docs, shards=7).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    for source in ("a", "b", "c", None):
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(1, 0.02 * own[0]["target"])


def test_members_that_differ_too_much_are_not_paired(spark, monkeypatch):
    """Copies of one text, each with two words of its own: their lists are shared, links are few."""
    base = [f"w{i}" for i in range(140)]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        at = rng.choice(np.arange(5, 135), 2, replace=False)
        rows.append((i, " ".join(f"x{i}" if k in at else w for k, w in enumerate(base))))
    pairs, write = [], set_join.stage

    def counted(df, label, by=None):
        out = write(df, label, by)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(set_join, "stage", counted)
    found = set_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == _linked(rows)
    assert sum(pairs) < 2 * len(rows)


def _linked(rows):
    sets = {i: set(zip(w, w[1:], w[2:])) for i, w in ((i, t.split(" ")) for i, t in rows)}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_set_join(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8])):
            words[rng.randrange(len(words))] = f"z{rng.randint(0, 50)}"
        rows.append((k, " ".join(words)))
    head = " ".join(f"q{i}" for i in range(40))
    rows += [(1000 + k, f"{head} " + " ".join(f"r{k}_{i}" for i in range(rng.randint(0, 8)))) for k in range(40)]
    rows += [(None, "a b c d e f g h i j k"), (5000, "A b c d e f g h i j k l"), (5001, None), (5002, "x y"), (5003, "X  Y"), (5004, "x")]
    for size, percent in ((3, 90), (5, 80)):
        found = collections.Counter(tuple(r) for r in set_join.groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect())
        sets = []
        for _, text in rows:
            words = (text or "").lower().split()
            sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
        parent = list(range(len(rows)))

        def root(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    parent[root(a)] = root(b)
        lowest = {}
        for k, (i, _) in enumerate(rows):
            if i is not None:
                lowest[root(k)] = min(lowest.get(root(k), i), i)
        assert found == collections.Counter((i, len(sets[k]), lowest.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("size", [13, 30])
def test_substrings(spark, size):
    rng = random.Random(size)
    passages = [[f"p{n}_{i}" for i in range(rng.randint(size - 2, 3 * size))] for n in range(6)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] + rng.choice(passages)[rng.randint(0, 3):]
        rows.append((k % 50, " ".join(words)))
    first = {}
    for i, text in rows:
        words = text.split()
        for at in range(len(words) - size + 1):
            key = tuple(words[at:at + size])
            first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, text in rows:
        words = text.split()
        gone = {at + k for at in range(len(words) - size + 1) if first[tuple(words[at:at + size])] < i for k in range(size)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in substrings.removal_report(docs, size).collect()) == want


def test_byte_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    sample = list(enumerate(odd_texts(400, 3)))
    found = {r["doc_id"]: tuple(r)[1:] for r in bpe_digests(spark.createDataFrame(sample, "doc_id long, text string")).collect()}
    for i, text in sample:
        ids = whole.encode_ordinary(text or "")
        assert found[i] == (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_id_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    sample = list(enumerate(odd_texts(300, 4)))
    docs = spark.createDataFrame(sample, "doc_id long, text string")
    folder = scratch_path(spark, "ids")
    manifest = id_files.write(docs, folder, path, id_files.sample_dictionary(docs, path))
    found = {r["doc_id"]: tuple(r)[1:] for r in id_files.read(manifest, folder).collect()}
    start = 0
    for i, text in sample:
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        assert found[i] == (start, len(ids), zlib.crc32(array.array("I", ids).tobytes()))
        start += len(ids)
    part = manifest.orderBy("part").first()
    assert np.frombuffer(id_files.IdFile(folder, part["path"]).ids(0), "<u4").tolist() == [1]
    fs, base = filesystem(folder)
    with fs.open_output_stream(f"{base}/dictionary.zdict") as out:
        out.write(b"another dictionary")
    with pytest.raises(ValueError, match="dictionary"):
        id_files.IdFile(folder, part["path"])


def test_piece_cache_forgets_and_relearns(monkeypatch):
    monkeypatch.setattr(id_files, "CACHE_PIECES", 3)
    encode = id_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one two three four five one six seven two", None, "", "One, oNE. 7; a), 'x's! ÀB, I\u0307. x\u00a0y? ß:; ..", "TWO ?!"]
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [array.array("I", own.encode(t or "", add_special_tokens=False).ids + [1]).tobytes() for t in texts]
    for _ in range(2):
        assert [encode(t) for t in texts] == want


def test_one_row_per_group(spark):
    """Null and repeated ids, rows without words, equal rows, clashing columns, an empty table."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (None, base + " x"), (None, None), (5, other), (5, base + " x y"), (5, other), (7, ""), (7, " "), (None, "alone without id here now yes"), (3, other + " z")]
    docs = spark.createDataFrame([(*r, "r", 1, 2) for r in rows], "doc_id long, text string, root string, _row int, first int")
    found = set_join.one_per_group(docs, size=5, percent=80)
    assert found.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in found.collect())
    assert got == collections.Counter([(1, base), (None, None), (7, ""), (7, " "), (None, "alone without id here now yes"), (3, other + " z")])
    assert set_join.one_per_group(docs.limit(0), size=5, percent=80).collect() == []


def test_pipeline_forms_on_hard_rows(spark):
    """Stages keep the columns of any table; empty tables and null texts pass through them."""
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, long, "a"), (1, long, "a"), (None, long, None), (2, None, "a"), (3, "", None), (4, long + " more", "b")]
    schema = "doc_id long, text string, source string, n_chars long, hash string, live int, size string, rank int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "h", 1, "s", 2) for r in rows], schema)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    for stage in (lambda d: rules.passed(d, labels), substrings.deduplicated, mixing.mixed, lambda d: set_join.one_per_group(d, size=5, percent=80)):
        assert stage(docs).columns == docs.columns and stage(docs.limit(0)).collect() == []
    cut = substrings.deduplicated(docs).collect()
    assert len(cut) == len(rows) and sorted(len((r["text"] or "").split()) for r in cut)[-1] == 400
    kept = rules.passed(docs, labels).collect()
    assert all((r["text"] or "").startswith("w0") for r in kept)
