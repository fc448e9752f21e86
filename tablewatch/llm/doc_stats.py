"""Statistics of whole documents, many at once: the inputs of the quality rules and of the classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewatch.llm import textbatch as tb

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct",
    "n_upper", "n_digits", "n_marks", "n_stops", "n_wide", "n_long", "n_short_lines", "n_bars",
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?;:=_\\{}[]@^~")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,")] = True


def _keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash of a value within its document."""
    with np.errstate(over="ignore"):
        return tb.mix(h + (doc.astype(tb.U64) + tb.U64(1)) * tb.U64(0xD6E8FEB86659FD93))


def _repeated_words(h: np.ndarray, w: tb.Words, size: int = 3) -> np.ndarray:
    """Which words lie in a window of ``size`` words that its document holds twice or more."""
    s, at = tb.shingles(h, w.doc, size)
    edge = np.zeros(len(h) + 1, dtype=np.int32)
    if len(s):
        _, inverse, counts = np.unique(_keyed(s, w.doc[at]), return_inverse=True, return_counts=True)
        twice = at[counts[inverse] > 1]
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + size, -1)
    return np.cumsum(edge[:-1]) > 0


def counts(block: tb.Block) -> dict[str, np.ndarray]:
    """COUNTS of each document of a block, as 64-bit integers."""
    data, n = block.data, block.n
    w = tb.words(block)
    h = tb.word_hashes(block, w)
    per_doc = lambda flags: tb.sums(flags, block.starts)
    per_word = lambda flags: tb.sums(flags, w.cuts)
    lines, line_doc, line_hash = tb.line_hashes(block)
    line_ends = np.append(lines[1:], len(data))
    line_words = np.searchsorted(w.start, line_ends) - np.searchsorted(w.start, lines)
    solid = line_words > 0
    line_cuts = np.searchsorted(line_doc, np.arange(n + 1))
    own = np.unique(_keyed(line_hash[solid], line_doc[solid]), return_index=True)[1]
    first = np.zeros(len(lines), dtype=bool)
    first[np.flatnonzero(solid)[own]] = True
    n_solid, n_first = tb.sums(solid, line_cuts), tb.sums(first, line_cuts)
    seen = np.zeros(len(h), dtype=bool)
    seen[np.unique(_keyed(h, w.doc), return_index=True)[1]] = True
    points = per_doc((data & 0xC0) != 0x80) - 1  # without the line feed that ends the document
    return {
        "n_words": np.diff(w.cuts),
        "word_chars": points - per_doc(tb.SPACE[data]) + 1,
        "n_symbols": per_doc(_SYMBOL[data]),
        "n_dup_lines": n_solid - n_first,
        "n_repeat_words": per_word(_repeated_words(h, w)),
        "n_chars": points,
        "n_lines": n_solid,
        "n_distinct": per_word(seen),
        "n_upper": per_doc(_UPPER[data]),
        "n_digits": per_doc(_DIGIT[data]),
        "n_marks": per_doc(_MARK[data]),
        "n_stops": per_doc(_STOP[data]),
        "n_wide": per_doc(data >= 0xC0),
        "n_long": per_word((w.end - w.start) > 15),
        "n_short_lines": tb.sums(solid & (line_words < 4), line_cuts),
        "n_bars": per_doc(data == 124),
    }


def _rows(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch.column(keep)):
            own = counts(block)
            kept = [batch.column(i).slice(block.first, block.n) for i in range(keep)]
            yield pa.record_batch(
                [*kept, *(pa.array(own[c].astype(np.int64)) for c in COUNTS)],
                names=[*batch.schema.names[:keep], *COUNTS],
            )


def doc_counts(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, the named columns and COUNTS for every row; a null text counts as empty."""
    keep = 1 + len(keys)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *(F.col(k).cast("string").alias(k) for k in keys),
        F.col("text").cast("string").alias("text"),
    )
    schema = ", ".join(["doc_id long", *(f"`{k}` string" for k in keys), *(f"{c} long" for c in COUNTS)])
    return rows.mapInArrow(lambda it: _rows(it, keep), schema)
