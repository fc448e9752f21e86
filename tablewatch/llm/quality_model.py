"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of every whole text are computed once, in Spark. Trees are fitted on at most ``max_labelled``
labelled documents (those first by a hash of their id, so the choice does not depend on partitioning): the
bound keeps the fit small enough for the driver whatever the corpus. Fitted trees are flattened into arrays
of fixed size and every document is scored by numpy traversal in Arrow batches.

Rows: null and empty texts are scored like any other (all statistics zero). A null doc_id is never learned
from and counts as held out. Labels with a null id or quality are left out; several labels of one document
count as their mean. Without labels every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewatch.llm.doc_stats import COUNTS, doc_counts
from tablewatch.llm.shared import written

MAX_LABELLED = 200_000
THRESHOLD = 0.3


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of statistics that do not grow with the text, but for its logarithmic length."""
    c = {k: v.astype(np.float64) for k, v in c.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars,
            c["n_marks"] / words, c["n_stops"] / words, c["n_wide"] / chars, c["n_long"] / words,
            c["n_short_lines"] / lines, c["n_bars"] / words, np.log1p(c["n_words"] / lines),
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Full binary trees of one depth as arrays: node i has the children 2 i + 1 and 2 i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes: go right above it
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0) -> Trees:
    """Boosting for the logistic loss; splits are sought in histograms of gradients over quantile bins."""
    inner, leaves = 2**depth - 1, 2**depth
    positive = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(positive / (1 - positive)))
    shape = (trees, inner)
    model = Trees(base, np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros((trees, leaves)))
    if not len(y):
        return model
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins)[1:-1], method="lower")) for f in x.T]
    width = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T, strict=True)], axis=1)
    columns = binned + np.arange(x.shape[1]) * width
    usable = np.arange(width - 1)[None, :] < np.array([len(e) for e in edges])[:, None]
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            size = 2**level * x.shape[1] * width
            flat = ((node - first)[:, None] * (x.shape[1] * width) + columns).ravel()
            g, h = (
                np.bincount(flat, np.repeat(v, x.shape[1]), size).reshape(2**level, x.shape[1], width).cumsum(axis=2)
                for v in (gradient, curve)
            )
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain = np.where(usable[None], gain[:, :, :-1], -1)
            best = gain.reshape(2**level, -1).argmax(axis=1)
            feature, cut = np.divmod(best, width - 1)
            good = gain.reshape(2**level, -1).max(axis=1) > 1e-9
            at = first + np.arange(2**level)
            model.feature[t, at] = feature
            model.limit[t, at] = [edges[f][c] if ok else np.inf for f, c, ok in zip(feature, cut, good, strict=True)]
            k = node - first
            node = 2 * node + 1 + (good[k] & (binned[np.arange(len(y)), feature[k]] > cut[k]))
        g, h = (np.bincount(node - inner, v, leaves) for v in (gradient, curve))
        model.value[t] = rate * g / (h + ridge)
        margin += model.value[t][node - inner]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(counts: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    """Fit on labelled documents outside the held-out fifth."""
    known = (
        labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))
    )
    rows = (
        counts.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(max_labelled)
        .select(*COUNTS, "label").toArrow()
    )
    return fit(features({k: rows[k].to_numpy() for k in COUNTS}), rows["label"].to_numpy())


def _scores(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features({k: batch.column(k).to_numpy(zero_copy_only=False) for k in COUNTS})
        yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(trees.score(x))], names=["doc_id", "held_out", "score"])


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    counts = written(doc_counts(docs))
    trees = train(counts, labels, max_labelled)
    return (
        counts.withColumn("held_out", held_out(F.col("doc_id")))
        .mapInArrow(lambda it: _scores(it, trees), "doc_id long, held_out boolean, score double")
        .withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    )
