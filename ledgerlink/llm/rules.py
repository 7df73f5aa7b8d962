"""Quality rules: an isolation forest over rule statistics.

One pass over the texts counts words, symbols, repeated lines and repeated word triples. Random
trees are grown on a bounded sample of the counted documents; documents whose mean path to a leaf
is short are anomalous. The score from which a document is rejected is set on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm import text_arrays as ta
from ledgerlink.llm.tables import lowest_hashes, stage

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TREES = 100
TREE_SAMPLE = 256
SAMPLE_ROWS = 20_000
SCORE_STEPS = 2_000
KEEP_GOOD = 0.998


def _again(keys: np.ndarray) -> np.ndarray:
    """For each key whether an equal one stands before it; and, as a second row, anywhere else."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.zeros((2, len(keys)), bool)
    out[0, order] = same[:-1]
    out[1, order] = same[:-1] | same[1:]
    return out


def slice_stats(t: ta.TextSlice) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    space = t.is_space()
    words = t.words
    start, end, line_doc = t.lines()
    solid = np.concatenate([[0], np.cumsum(~space)])
    full = solid[end] > solid[start]
    lines = ta.mix(t.hashes(start[full], end[full]) ^ ta.mix(line_doc[full].astype(np.uint64)))
    at, triple = t.windows(3, words)
    twice = _again(ta.mix(triple ^ ta.mix(t.doc[at].astype(np.uint64))))[1]
    covered = np.zeros(len(words) + 2, bool)
    for shift in range(3):
        covered[at[twice] + shift] = True
    return {
        "n_words": t.n_words,
        "word_chars": t.per_doc(~space & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.per_doc(np.isin(t.data, np.frombuffer(SYMBOLS, np.uint8))),
        "n_dup_lines": np.bincount(line_doc[full][_again(lines)[0]], minlength=t.docs),
        "n_repeat_words": np.bincount(t.doc[covered[:len(words)]], minlength=t.docs),
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, t in ta.slices(batch):
            stats = slice_stats(t)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(stats[k], pa.int64()) for k in stats)], ["doc_id", *stats])


def statistics(docs: DataFrame) -> DataFrame:
    """Counts per document of ``docs`` (doc_id, text); null and empty texts count nothing."""
    return docs.select("doc_id", "text").mapInArrow(_count, STATS)


def base_failed(n_words: str = "n_words", repeats: str = "n_repeat_words"):
    return (F.col(n_words) < MIN_WORDS) | (F.col(repeats) * 100 > F.col(n_words) * MAX_REPEAT_PERCENT)


def features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) -> np.ndarray:
    """Length-free shares, so that long documents do not stand out for being long.

    Symbols enter per character, per word and as a logarithm, so that splits meet them often.
    Repeats enter in quarters, with repeated lines: the base rule already rejects by repeats, and
    finer steps would make a short text with one repeated sentence look rarer than symbol junk.
    """
    words = np.maximum(n_words, 1).astype(float)
    chars = np.maximum(word_chars, 1).astype(float)
    repeats = np.maximum(n_repeat_words, np.minimum(n_dup_lines, words)) / words
    return np.column_stack([n_symbols / chars, n_symbols / words, np.log1p(n_symbols), np.floor(4 * repeats) / 4])


def _path_rest(n: np.ndarray | int) -> np.ndarray:
    """Mean depth that unsplit rows would still have."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: node -> feature (-1: leaf), split, left child; right is left + 1."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    depth: int
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, from 0 to 1; short mean paths score high."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                right = x[rows, np.maximum(f, 0)] >= self.split[node]
                node = np.where(f < 0, node, self.left[node] + right)
            total += self.length[node]
        return np.exp2(-total / len(self.roots) / _path_rest(self.sample))


def grow(x: np.ndarray, trees: int = TREES, sample: int = TREE_SAMPLE, seed: int = 7) -> Forest:
    """Isolation trees, each on ``sample`` rows of ``x``, split at random down to log2(sample)."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    depth = int(np.ceil(np.log2(max(size, 2))))
    feature, split, left, length, roots = [], [], [], [], []

    def add() -> int:
        for column, empty in ((feature, -1), (split, 0.0), (left, 0), (length, 0.0)):
            column.append(empty)
        return len(feature) - 1

    for _ in range(trees):
        roots.append(add())
        todo = [(roots[-1], x[rng.choice(len(x), size, replace=False)], 0)]
        while todo:
            node, rows, level = todo.pop()
            wide = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
            if level >= depth or not len(wide):
                length[node] = level + float(_path_rest(len(rows)))
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(rows[:, f].min(), rows[:, f].max())
            at = at if at > rows[:, f].min() else rows[:, f].max()
            feature[node], split[node], left[node] = f, at, add()
            add()
            for child, part in ((left[node], rows[:, f] < at), (left[node] + 1, rows[:, f] >= at)):
                todo.append((child, rows[part], level + 1))
    return Forest(*map(np.array, (feature, split, left, length, roots)), depth, max(size, 2))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with the anomaly score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(x))], [*batch.schema.names, "anomaly"])

    return stats.mapInArrow(run, STATS + ", anomaly double")


def threshold(labelled: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """Score from which rows are rejected, from ``labelled`` (anomaly, quality).

    All labelled rows enter, as counts per score step. Among the scores above which at most
    ``1 - keep_good`` of the good rows lie, the one that splits good from bad best, in the middle of
    its ties; no score at
    all (2.0) if there are no labels of both kinds.
    """
    step = F.floor(F.col("anomaly") * SCORE_STEPS).cast("int").alias("step")
    counts = np.zeros((2, SCORE_STEPS + 2))
    for row in labelled.where("quality in (0, 1)").groupBy(step, "quality").count().collect():
        counts[row["quality"], row["step"]] += row["count"]
    if not counts.sum(axis=1).all():
        return 2.0
    bad, good = counts[:, ::-1].cumsum(axis=1)[:, ::-1] / counts.sum(axis=1, keepdims=True)
    gain = np.where(good <= 1 - keep_good, bad - good, -1.0)
    best = np.flatnonzero(gain == gain.max())
    return float(best[len(best) // 2] / SCORE_STEPS) if gain.max() > 0 else 2.0


def fitted(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """Forest and rejection threshold from counted documents and ``labels`` (doc_id, quality); None
    if the base rule leaves no document."""
    usable = stats.where(~base_failed())
    rows = lowest_hashes(usable, SAMPLE_ROWS, "forest", "doc_id", "n_words", "word_chars").drop("doc_id").collect()
    if not rows:
        return None
    forest = grow(features(*np.array(rows, float).T))
    known = labels.select("doc_id", "quality").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return forest, threshold(scored(usable, forest).join(known, "doc_id"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base rule and verdict per document.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality (other columns are not read).
    Rows with equal ids are judged one by one. Without documents or labels the base rule decides.
    """
    stats = stage(statistics(docs), "rule-stats")
    fit = fitted(stats, labels)
    if fit is None:
        return stats.select("*", F.lit(0.0).alias("anomaly"), base_failed().alias("base_failed"), (~base_failed()).alias("kept"))
    marked = scored(stats, fit[0])
    return marked.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < fit[1]))


def passed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that are kept. Texts are counted again on
    the way instead of being joined to their verdicts, so rows without id are judged like others."""
    fit = fitted(stage(statistics(docs), "rule-stats"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, t in ta.slices(batch):
                stats = slice_stats(t)
                n, repeats = stats["n_words"], stats["n_repeat_words"]
                keep = (n >= MIN_WORDS) & (100 * repeats <= n * MAX_REPEAT_PERCENT)
                if fit:
                    keep &= fit[0].scores(features(*stats.values())) < fit[1]
                yield rows.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
