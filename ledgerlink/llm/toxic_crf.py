"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Two states, clean and toxic, per word. A word's potential is a sum of hashed features of itself
(word, beginnings, ending) and of its neighbours; transitions have weights of their own. Words of
labelled toxic documents are labelled toxic where a feature of theirs stands in several unrelated
toxic documents and hardly ever in clean ones; all other words are clean. Weights are fitted by
gradient steps on the exact likelihood, from forward-backward marginals.

Scoring runs forward and backward over every whole text. Words with a marginal of one half or more
form the offending spans. The highest log-odds and the expected toxic words of the densest run of
``RUN_WORDS`` words give the document's score through a logistic fit. Both are maxima over the text,
so a text does not come out toxic for being long: it scores what its worst passage scores. The fit
is made on the whole texts of the labelled sample, which tasks reduce to these two numbers.

The sample of the chain holds at most ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` labelled documents. Of a text of more than
``SAMPLE_CHARS`` characters it holds ``PIECES`` pieces of ``PIECE_CHARS`` characters, drawn by hash from
the whole text, so length does not decide whether a label is learned from. Null and empty texts have no words and get the score of that. Rows
with equal ids are scored one by one. Without labels of both kinds every score is the share of
toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm import text_arrays as ta
from ledgerlink.llm.tables import lowest_hashes

SAMPLE_TOXIC = 1_500
SAMPLE_CLEAN = 2_500
SAMPLE_CHARS = 6_000
PIECES = 8
PIECE_CHARS = 500
TABLE_BITS = 18
BEGINNINGS = (3, 4, 5, 6)
MIN_DOCS = 4
MIN_SHARE = 0.01
MIN_PURITY = 0.97
SEGMENT = 32
RUN_WORDS = 64
STEPS = 80
SPANS = "array<struct<start:long,end:long>>"
_PUNCTUATION = np.array([chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for b in range(128)] + [False] * 128)


def word_features(t: ta.TextSlice) -> np.ndarray:
    """Hashed features of each word itself, one column each; surrounding punctuation is left out."""
    start, end = t.start.copy(), t.end.copy()
    for _ in range(3):
        start += (end - start > 1) & _PUNCTUATION[t.data[start]]
        end -= (end - start > 1) & _PUNCTUATION[t.data[end - 1]]
    columns = [t.hashes(start, end)]
    columns += [t.hashes(start, np.minimum(start + n, end)) for n in BEGINNINGS]
    columns += [t.hashes(np.maximum(end - 3, start), end)]
    salts = ta.mix(np.arange(len(columns), dtype=np.uint64) + np.uint64(77))
    return np.column_stack([(ta.mix(c ^ s) >> np.uint64(64 - TABLE_BITS)).astype(np.int32) for c, s in zip(columns, salts)])


@dataclass(frozen=True)
class Model:
    """Feature weights for the word itself, its left and its right neighbour; transition weights
    [from, to]; and the logistic fit of the document score."""

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    moves: np.ndarray
    logistic: np.ndarray

    def potentials(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Log-potential of the toxic state against the clean one for each word."""
        out = self.own[features].sum(1)
        if len(doc) > 1:
            same = doc[1:] == doc[:-1]
            out[1:] += self.left[features[:-1]].sum(1) * same
            out[:-1] += self.right[features[1:]].sum(1) * same
        return out


def marginal_odds(potentials: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log-odds of the toxic state at each word by forward-backward over whole texts.

    With two states both messages are ratios. Texts are taken together, longest first, one word of
    each per step.
    """
    stay, enter, leave, remain = np.exp(moves).ravel()
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    ratio = np.exp(np.clip(potentials, -30, 30))
    forward, backward = np.empty_like(ratio), np.ones_like(ratio)
    for step, n in enumerate(active):
        at = starts[:n] + step
        if step:
            before = forward[at - 1]
            forward[at] = ratio[at] * (enter + remain * before) / (stay + leave * before)
        else:
            forward[at] = ratio[at]
    for step in range(len(active) - 2, -1, -1):
        at = starts[:active[step + 1]] + step
        after = ratio[at + 1] * backward[at + 1]
        backward[at] = (leave + remain * after) / (stay + enter * after)
    return np.log(forward) + np.log(backward)


def _segments(doc: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """First words of training segments: around toxic words, and a few anywhere."""
    hot = np.flatnonzero(labels)
    first = np.concatenate([hot - rng.integers(0, SEGMENT, len(hot)), rng.integers(0, max(1, len(doc) - SEGMENT), min(8000, len(doc)))])
    first = np.unique(first[(first >= 0) & (first + SEGMENT <= len(doc))])
    return first[doc[first] == doc[first + SEGMENT - 1]]


def fit_chain(features: np.ndarray, doc: np.ndarray, labels: np.ndarray, seed: int = 11) -> Model:
    """Weights that maximise the likelihood of ``labels`` over segments, by Adam steps with decay."""
    rng = np.random.default_rng(seed)
    size = 1 << TABLE_BITS
    tables, moves = np.zeros((3, size)), np.zeros((2, 2))
    first = _segments(doc, labels, rng)
    if not len(first):
        return Model(*tables, moves, np.zeros(3))
    at = first[:, None] + np.arange(SEGMENT)
    own = features[at]
    truth = labels[at].astype(float)
    counts = np.full(len(first), SEGMENT)
    state = [np.zeros_like(tables), np.zeros_like(tables), np.zeros_like(moves), np.zeros_like(moves)]
    before, after = truth[:, :-1], truth[:, 1:]
    seen = np.array([[((1 - before) * (1 - after)).sum(), ((1 - before) * after).sum()], [(before * (1 - after)).sum(), (before * after).sum()]])
    for step in range(1, STEPS + 1):
        potentials = tables[0][own].sum(2)
        potentials[:, 1:] += tables[1][own[:, :-1]].sum(2)
        potentials[:, :-1] += tables[2][own[:, 1:]].sum(2)
        odds = marginal_odds(potentials.ravel(), counts, moves).reshape(truth.shape)
        p = 1 / (1 + np.exp(-odds))
        error = (truth - p) / len(first)
        grads = np.zeros_like(tables)
        for table, rows, part in ((0, own, error), (1, own[:, :-1], error[:, 1:]), (2, own[:, 1:], error[:, :-1])):
            grads[table] = np.bincount(rows.ravel(), np.repeat(part.ravel(), rows.shape[2]), minlength=size)
        q, r = p[:, :-1], p[:, 1:]
        both = _pair_toxic(q, r, moves)
        expected = np.array([[(1 - q - r + both).sum(), (r - both).sum()], [(q - both).sum(), both.sum()]])
        move_grads = (seen - expected) / len(first) / SEGMENT
        for values, g, m, v, rate in ((tables, grads - 1e-6 * tables, state[0], state[1], 0.15), (moves, move_grads, state[2], state[3], 0.05)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            values += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return Model(*tables, moves, np.zeros(3))


def _pair_toxic(q: np.ndarray, r: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic, toxic) of neighbours with marginals q and r: the table with these margins and the
    odds ratio that the transitions set, which is the pair marginal of a two-state chain."""
    ratio = np.exp(moves[0, 0] + moves[1, 1] - moves[0, 1] - moves[1, 0])
    if abs(ratio - 1) < 1e-9:
        return q * r
    s = 1 + (q + r) * (ratio - 1)
    return (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * q * r, 0))) / (2 * (ratio - 1))


def label_words(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Toxic words of the sample. Documents that repeat runs of words of an earlier one count with
    it, so that what a group of copies shares is not taken for a sign."""
    runs = ta.window_hashes(features[:, 0].astype(np.uint64), 5)
    bounds = np.searchsorted(doc, np.arange(len(toxic) + 1))
    seen: set[int] = set()
    evidence: tuple[list[np.ndarray], list[np.ndarray]] = [], []
    columns = np.arange(features.shape[1], dtype=np.int32) << TABLE_BITS
    for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        own = runs[a:max(a, b - 4)]
        few = set(own[own % np.uint64(4) == 0].tolist())
        if few and len(few & seen) > 0.2 * len(few):
            continue
        seen |= few
        evidence[toxic[d]].append(np.unique(features[a:b] + columns))
    if not evidence[1]:
        return np.zeros(len(features), bool)
    signs, found = np.unique(np.concatenate(evidence[1]), return_counts=True)
    often = found >= max(MIN_DOCS, MIN_SHARE * len(evidence[1]))
    signs, found = signs[often], found[often]
    clean = np.sort(np.concatenate(evidence[0])) if evidence[0] else np.zeros(0, np.int32)
    against = np.searchsorted(clean, signs, side="right") - np.searchsorted(clean, signs, side="left")
    signs = signs[found >= MIN_PURITY * (found + against * len(evidence[1]) / max(1, len(evidence[0])))]
    hit = np.zeros(len(features), bool)
    for c in range(features.shape[1]):
        hit |= np.isin(features[:, c] + columns[c], signs)
    return hit & (toxic[doc] == 1)


def summaries(odds: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Highest log-odds of each text, log of the expected toxic words of its densest run, and a
    constant."""
    top = np.full(docs, -12.0)
    np.maximum.at(top, doc, np.clip(odds, -12, 12))
    sums = np.concatenate([[0.0], np.cumsum(1 / (1 + np.exp(-np.clip(odds, -30, 30))))])
    ends = np.cumsum(np.bincount(doc, minlength=docs))[doc]
    at = np.arange(len(doc))
    densest = np.zeros(docs)
    np.maximum.at(densest, doc, sums[np.minimum(at + RUN_WORDS, ends)] - sums[at])
    return np.column_stack([top, np.log1p(densest), np.ones(docs)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood, both classes weighing alike."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, grad)
    return w


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """The model of labelled texts."""
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts, docs, base = [], [], 0
    for _, t in ta.slices(batch, lower=True):
        parts.append(word_features(t))
        docs.append(t.doc + base)
        base += t.docs
    features, doc = np.concatenate(parts), np.concatenate(docs)
    model = fit_chain(features, doc, label_words(features, doc, toxic))
    odds = marginal_odds(model.potentials(features, doc), np.bincount(doc, minlength=len(toxic)), model.moves)
    return calibrated(model, summaries(odds, doc, len(toxic)), toxic)


def calibrated(model: Model, x: np.ndarray, toxic: np.ndarray) -> Model:
    """``model`` with the logistic fit of labels to the ``summaries`` of their texts."""
    return Model(model.own, model.left, model.right, model.moves, fit_logistic(x, toxic.astype(float)))


def excerpt(text: Column, doc_id: Column) -> Column:
    """The text, or of a long one the drawn pieces in their order, without words cut at their ends."""
    numbers = F.sequence(F.lit(0), F.ceil(F.length(text) / PIECE_CHARS).cast("int") - 1)
    drawn = F.slice(F.array_sort(F.transform(numbers, lambda i: F.struct(F.xxhash64(doc_id, i).alias("draw"), i.alias("i")))), 1, PIECES)
    pieces = F.transform(F.array_sort(drawn["i"]), lambda i: F.regexp_replace(
        F.substr(text, i * PIECE_CHARS + 1, F.lit(PIECE_CHARS)), r"^\S+\s|\s\S+$", ""))
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.array_join(pieces, "\n"))


def picked_labels(labels: DataFrame) -> DataFrame:
    """Bounded labelled sample (doc_id, toxic): of each kind the ids with the lowest hash, picked
    before any text is read, so the ids are safe to broadcast."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return lowest_hashes(known.where("toxic = 1"), SAMPLE_TOXIC, "toxic", "doc_id").union(
        lowest_hashes(known.where("toxic = 0"), SAMPLE_CLEAN, "toxic", "doc_id"))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts, long ones in excerpts, and labels of the sample."""
    found = docs.where("text is not null").join(F.broadcast(picked_labels(labels)), "doc_id")
    rows = found.select("doc_id", excerpt(F.col("text"), F.col("doc_id")).alias("text"), "toxic").toPandas().sort_values(["doc_id", "text"])
    return rows["text"].tolist(), rows["toxic"].to_numpy(np.int64)


def _document_odds(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, ta.TextSlice, np.ndarray]]:
    for batch in batches:
        for rows, t in ta.slices(batch, lower=True):
            yield rows, t, marginal_odds(model.potentials(word_features(t), t.doc), t.n_words, model.moves)


def whole_text_fit(docs: DataFrame, labels: DataFrame, trained: Model) -> Model:
    """``trained`` with the score fitted to whole texts of the sample: two numbers per text and its
    label leave the tasks."""
    model = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t, odds in _document_odds(model.value, batches):
            x = summaries(odds, t.doc, t.docs)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), rows.column("toxic")], ["top", "dense", "toxic"])

    found = docs.where("text is not null").join(F.broadcast(picked_labels(labels)), "doc_id").select("text", F.col("toxic").cast("int"))
    rows = found.mapInArrow(run, "top double, dense double, toxic int").toPandas().sort_values(["top", "dense", "toxic"])
    return calibrated(trained, np.column_stack([rows["top"], rows["dense"], np.ones(len(rows))]), rows["toxic"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and offending spans (character offsets) per row of ``docs`` (doc_id, text).
    ``labels`` (doc_id, toxic) holds the labels that may be learned from."""
    texts, toxic = sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    if len(set(toxic.tolist())) < 2:
        share = float(toxic.mean()) if len(toxic) else 0.0
        return docs.select("doc_id", F.lit(share).alias("score"), F.array().cast(SPANS).alias("spans"))
    trained = whole_text_fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), train(texts, toxic))
    model = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for rows, t, odds in _document_odds(m, batches):
            score = 1 / (1 + np.exp(-np.clip(summaries(odds, t.doc, t.docs) @ m.logistic, -30, 30)))
            hot = np.flatnonzero(odds >= 0)
            opens = np.ones(len(hot), bool)
            opens[1:] = (np.diff(hot) > 1) | (t.doc[hot[1:]] != t.doc[hot[:-1]])
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(hot)) - 1
            first, last = hot[first], hot[last[:len(first)]]
            chars = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
            base = chars[t.offsets[t.doc[first]]]
            spans = pa.StructArray.from_arrays([pa.array(chars[t.start[first]] - base), pa.array(chars[t.end[last]] - base)], fields=list(span))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(t.doc[first], minlength=t.docs))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(pa.array(bounds), spans)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, spans {SPANS}")
