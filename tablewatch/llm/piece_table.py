"""SentencePiece encoding and decoding through a table of distinct chunks.

The library turns a space into the marker U+2581 and puts one before the text. When no piece of the model
holds a marker after another character, no merge can cross the start of a run of markers, so a text is a
sequence of independent chunks: a run of markers and the characters up to the next run. Each distinct chunk is
segmented once and kept in a table with its ids, their decimal form and its decoded text; a document's ids are
its chunks' entries joined back by position. Decoding looks the same chunks up by their ids.

The table lives in the Python worker, not in a shuffle: a row per occurrence of a word would move several times the
text, while a table fills within seconds, serves the worker's later tasks too, and documents stay where they are read. It is emptied when it
reaches ``MAX_CHUNKS``, so memory is bounded whatever the vocabulary (chunks longer than ``LONG`` are not
kept). A model whose pieces can cross a marker is refused by ``split_safe``.

Rows: a null or empty text has no ids and decodes to the empty text. A null doc_id and repeated rows are kept
as they are. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MAX_CHUNKS = 300_000
LONG = 200
BATCH = 2_000  # new chunks segmented at once

_CHUNKS = re.compile(rf"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


def split_safe(model: sentencepiece.SentencePieceProcessor, pieces: list[str]) -> bool:
    """Whether no piece holds a marker after another character, and spaces are kept with a marker put before the text."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    probe = "".join(pieces[i] for i in model.encode("a  b"))
    return not any(crossing.search(p) for p in pieces) and probe == f"{MARK}a{MARK}{MARK}b"


class ChunkTable:
    """Distinct chunks with their segmentation; a chunk is named without its first marker, which the library adds."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor) -> None:
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if not split_safe(model, pieces):
            raise ValueError("pieces of this model can cross white space markers")
        self.model = model
        # number of ids, ids as text, decoded text: plain values, which the garbage collector does not visit again and again
        self.rows: dict[str, tuple[int, str, str]] = {}
        self.number = [str(i) for i in range(len(pieces))]
        self.opens = np.array([p.startswith(MARK) for p in pieces])
        self.blank = np.array([not p.strip(MARK) for p in pieces])
        plain = (not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(len(pieces)))
        self.surface = [p.replace(MARK, " ") if own else None for p, own in zip(pieces, plain, strict=True)]
        # what the decoder puts before the first character is dropped with the marker that stands there
        self.lead = model.encode("a")
        self.lead_text = model.decode(self.lead)

    def _decoded(self, ids: list[int]) -> str:
        surface = self.surface
        try:
            return "".join([surface[i] for i in ids])
        except TypeError:  # bytes of a character, which only the decoder puts together
            return self.model.decode(self.lead + ids)[len(self.lead_text) :]

    def _add(self, chunks: list[str]) -> None:
        """Segment new chunks, many in one text: its ids part where a marker follows another character."""
        solid = [c for c in chunks if c.strip(f" {MARK}")]
        for at in range(0, len(solid), BATCH):
            part = solid[at : at + BATCH]
            ids = self.model.encode(" ".join(part))
            known = np.array(ids, dtype=np.int64)
            starts = [0, *(np.flatnonzero(self.opens[known[1:]] & ~self.blank[known[:-1]]) + 1).tolist(), len(ids)]
            for k, chunk in enumerate(part):
                self._keep(chunk, ids[starts[k] : starts[k + 1]])
        for chunk in chunks:
            if not chunk.strip(f" {MARK}"):  # ends a text; the library cannot be given a single marker
                self._keep(chunk, self.model.encode(chunk) or [self.model.piece_to_id(MARK)])

    def _keep(self, chunk: str, ids: list[int]) -> None:
        self.rows[chunk] = (len(ids), ",".join([self.number[i] for i in ids]), self._decoded(ids))

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text in order, each without its first marker."""
        if not text:
            return []
        # one marker goes before the text; then every chunk starts with one
        return [c[1:] for c in _CHUNKS.findall(MARK + text)]

    def look_up(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        rows = self.rows
        new = set(chunks).difference(rows)
        if new:
            if len(rows) + len(new) > MAX_CHUNKS:
                rows.clear()
                new = set(chunks)
            self._add(sorted(new))
        out = [rows[c] for c in chunks]
        for chunk in new:
            if len(chunk) > LONG:
                del rows[chunk]
        return out

    def encode(self, text: str) -> list[int]:
        ids = ",".join([r[1] for r in self.look_up(self.chunks(text))])
        return [int(i) for i in ids.split(",")] if ids else []

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, hash of the ids and hash of the decoded text."""
        rows = self.look_up(self.chunks(text))
        ids = hashlib.sha256(",".join([r[1] for r in rows]).encode()).hexdigest()
        # the first chunk's leading marker is the one that decoding drops
        decoded = "".join([r[2] for r in rows])[1:] if rows else ""
        return sum([r[0] for r in rows]), ids, hashlib.sha256(decoded.encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def _load(model_path: str) -> ChunkTable:
    """The table of a model, kept for the life of a Python worker: its next task starts with the words of the last one."""
    kept = sys.modules.setdefault("_kept_chunks", types.ModuleType("_kept_chunks")).__dict__
    if model_path not in kept:
        kept[model_path] = ChunkTable(sentencepiece.SentencePieceProcessor(model_file=model_path))
    return kept[model_path]


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """Every row of ``docs`` with ``ids array<int>`` and ``decoded string``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _load(model_path)
        for batch in batches:
            ids = [np.array(table.encode(t.as_py() or ""), dtype=np.int32) for t in batch.column("text")]
            decoded = [table.decode(i.tolist()) for i in ids]
            yield pa.record_batch([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*batch.schema.names, "ids", "decoded"])

    plain = docs.drop("ids", "decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(rows, f"{fields}, ids array<int>, decoded string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _load(model_path)
        for batch in batches:
            own = [table.digest(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([r[i] for r in own], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, DIGEST)
