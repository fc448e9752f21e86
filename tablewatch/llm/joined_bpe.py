"""Byte-level BPE encoding and decoding; long texts are encoded in halves and joined in a tree.

A text of up to ``LEAF`` code points is encoded where it is read. A longer one is halved until the parts are short;
the parts are dealt to all tasks, encoded there, and joined pairwise, ``FAN`` parts to a task and level, until one
sequence of ids is left. A join encodes a window around it anew: some tokens of the left part and some of the right
one, twice as many each time, until the new tokens agree with both sides exactly:

* left: the window starts where a pre-token of the left part starts, or inside one with the same token as before;
* right: a new token ends where a token of the right part ends, and either a pre-token starts there in both, or both
  are inside a pre-token and their last tokens are equal.

This gives the library's ids and no others, because merges by rank are local: a sequence of tokens is the encoding of a
pre-token exactly if every two neighbours are the encoding of their own concatenation (the first merge over a border
would have been the best of those two tokens alone, too). The pattern that cuts pre-tokens looks back at nothing, one
character ahead, and two after an apostrophe; ``margin`` keeps windows clear of that and of added tokens cut in two.
A window that reaches the whole of both parts always agrees.

What is encoded where it is read, texts and parts, goes through a table: no pre-token holds white space after another
character, and the pattern looks back at nothing, so a text is a sequence of independent chunks, each from a space or line feed that follows
another character. Each distinct chunk is encoded once and its ids and decoded text are kept in the Python worker. A table of ``MAX_CHUNKS``
makes room for the next one; chunks longer than ``LONG`` are not kept, so memory is bounded whatever the texts.

Rows: one per row of ``docs``; a null or empty text has no ids and decodes to the empty text. A null doc_id and
repeated rows are kept as they are. Other columns are ignored; an empty table gives an empty result. No text is cut
off: the longest row bounds the memory of one task (its text, or four bytes and a flag for each of its ids).
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewatch.llm.shared import written

LEAF = 32_768  # code points encoded in one piece
FAN = 16  # parts that one task joins at a level
WINDOW = 8  # tokens on each side of a join, at first
BATCH_CHARS = 1 << 20  # ids handed on at once
MAX_CHUNKS = 75_000  # the long and the short texts of a task have workers and tables of their own
LONG = 200

# A border is cut only behind what is no white space in any version of Unicode (U+180E, U+200B and U+FEFF are or were taken for it).
_WIDE = r"\s\u180e\u200b\ufeff"
_BORDER = re.compile(rf"(?<=[^{_WIDE}])(?=[ \n])")
_ODD = re.compile(rf"[{_WIDE}][ \n]|\x00")


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ChunkTable:
    """What was made of the chunks seen last: up to ``MAX_CHUNKS`` of now, and as many of before, from which those that are met again move on."""

    def __init__(self, made: Callable[[list[str]], Iterator[tuple]]) -> None:
        self.made = made
        self.now: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def look_up(self, chunks: list[str]) -> list[tuple]:
        new = set(chunks).difference(self.now)
        if new:
            if len(self.now) + len(new) > MAX_CHUNKS:
                self.now, self.before = {}, self.now
                new = set(chunks)
            known = {c: self.before[c] for c in new if c in self.before}
            missing = [c for c in new if c not in known]
            self.now.update(known)
            self.now.update(zip(missing, self.made(missing), strict=True))
        rows = [self.now[c] for c in chunks]
        for chunk in new:
            if len(chunk) > LONG:
                del self.now[chunk]
        return rows


class Part:
    """Ids of a stretch of text, and which of them start a pre-token when the stretch stands alone."""

    def __init__(self, ids: list[int], starts: list[bool]) -> None:
        self.ids, self.starts = ids, starts


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        from tokenizers import Tokenizer

        self.tokens = Tokenizer.from_file(path)
        self.tokens.no_truncation()
        self.tokens.no_padding()
        plan = json.loads(self.tokens.to_str())
        model, cut = plan["model"], plan["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or plan["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("only byte-level BPE with its own pattern, without a normaliser, can be joined")
        added = plan["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or _folds(t["content"]) for t in added):
            raise ValueError("added tokens must be matched as they are and not overlap themselves")
        byte_of = _byte_of()
        vocabulary = self.tokens.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            whole = all(c in byte_of for c in token)
            self.bytes[i] = bytes(byte_of[c] for c in token) if whole else token.encode()
        self.added = {t["id"] for t in added}
        self.margin = 16 + max((len(t["content"].encode()) for t in added), default=0)
        self.whole = any(c in t["content"] for t in added for c in " \n")  # an added token could cross a border of chunks
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.known_codes, self.known_parts = ChunkTable(self._new_codes), ChunkTable(self._new_parts)

    def chunks(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        if _ODD.search(text):
            return _BORDER.split(text)
        # every space and line feed is a border; replacing is faster than a pattern
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def _new_codes(self, chunks: list[str]) -> Iterator[tuple[bytes, str]]:
        for chunk, own in zip(chunks, self.tokens.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            ids = own.ids
            decoded = self.decode(ids)
            yield b"".join([self.packed[i] for i in ids]), chunk if decoded == chunk else decoded  # one string in memory, not two

    def _new_parts(self, chunks: list[str]) -> Iterator[tuple[bytes, bytes]]:
        for chunk in chunks:
            part = self.part(chunk)
            yield _packed(part.ids), bytes(part.starts)

    def codes(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a text, and what they decode to."""
        rows = self.known_codes.look_up(self.chunks(text))
        return b"".join([r[0] for r in rows]), "".join([r[1] for r in rows])

    def leaf(self, text: str) -> tuple[bytes, bytes]:
        """``part``, packed."""
        rows = self.known_parts.look_up(self.chunks(text))
        return b"".join([r[0] for r in rows]), b"".join([r[1] for r in rows])

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.bytes[i] for i in ids])
        try:
            return raw.decode()
        except UnicodeDecodeError:  # never from ids of a text
            return self.tokens.decode(ids, skip_special_tokens=False)

    def part(self, text: str) -> Part:
        own = self.tokens.encode(text, add_special_tokens=False)
        ids, word = own.ids, own.word_ids
        alone = self.added
        return Part(ids, [k == 0 or word[k] != word[k - 1] or ids[k] in alone or ids[k - 1] in alone for k in range(len(ids))])

    def _inside(self, i: int) -> bool:
        return 0x80 <= self.bytes[i][0] < 0xC0

    def join(self, a: Part, b: Part) -> Part:
        """The encoding of both stretches as one."""
        if not a.ids or not b.ids:
            return a if a.ids else b
        k = WINDOW
        while (out := self._joined(a, b, k)) is None:
            k *= 2
        return out

    def _joined(self, a: Part, b: Part, k: int) -> Part | None:
        first = max(0, len(a.ids) - k)
        size = sum(len(self.bytes[i]) for i in a.ids[first:])
        # a mark of a contraction inside a run of signs would be read as the start of one
        while first and (size < self.margin or self._inside(a.ids[first]) or (not a.starts[first] and self.bytes[a.ids[first]][:1] == b"'")):
            first -= 1
            size += len(self.bytes[a.ids[first]])
        last = min(k, len(b.ids))
        while last < len(b.ids) and self._inside(b.ids[last]):
            last += 1
        new = self.part(b"".join([self.bytes[i] for i in a.ids[first:] + b.ids[:last]]).decode())
        if first:
            new.starts[0] = a.starts[first]
            if not a.starts[first] and new.ids[0] != a.ids[first]:
                return None
        head_ids, head_starts = a.ids[:first], a.starts[:first]
        if last == len(b.ids):
            return Part(head_ids + new.ids, head_starts + new.starts)
        at_b = {p: j for j, p in enumerate(accumulate((len(self.bytes[i]) for i in b.ids[:last]), initial=size))}
        ends = list(accumulate(len(self.bytes[i]) for i in new.ids))
        for m in range(1, len(new.ids)):
            p = ends[m - 1]
            if ends[-1] - p < self.margin:
                break
            j = at_b.get(p)
            if j is None or new.starts[m] != b.starts[j]:
                continue
            if new.starts[m] or (j and new.ids[m - 1] == b.ids[j - 1]):
                return Part(head_ids + new.ids[:m] + b.ids[j:], head_starts + new.starts[:m] + b.starts[j:])
        return None

    def tree(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]


def _folds(content: str) -> bool:
    """Whether an end of the string is also its start, so that two occurrences could overlap."""
    return any(content.startswith(content[k:]) for k in range(1, len(content)))


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in the life of a Python worker."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def halves(length: int, leaf: int) -> int:
    """Into how many parts a text of this length is cut: the smallest power of two that makes them short enough."""
    return 1 << max(0, -(-length // leaf) - 1).bit_length()


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _read(ids: bytes, starts: bytes) -> Part:
    return Part(np.frombuffer(ids, dtype="<u4").tolist(), np.frombuffer(starts, dtype=bool).tolist())


CODES = "doc_id long, ids binary, decoded string"
PARTS = "row long, doc_id long, part long, parts long, ids binary, starts binary"


def _record(values: list[tuple], names: list[str], types_: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*values, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types_, strict=True)], names=names)


def _codes(values: list[tuple]) -> pa.RecordBatch:
    return _record(values, ["doc_id", "ids", "decoded"], [pa.int64(), pa.binary(), pa.string()])


def _short(docs: DataFrame, path: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            out, size = [], 0
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids, decoded = own.codes(text.as_py() or "")
                out.append((doc.as_py(), ids, decoded))
                size += len(ids) // 4
                if size > BATCH_CHARS:
                    yield _codes(out)
                    out, size = [], 0
            yield _codes(out)

    return docs.mapInArrow(rows, CODES)


def _long(docs: DataFrame, path: str, leaf: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "part", "parts", "text"]
        kinds = [pa.int64()] * 4 + [pa.string()]
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text")), strict=True):
                whole = text.as_py()
                n = halves(len(whole), leaf)
                at = [k * len(whole) // n for k in range(n + 1)]
                for k in range(n):
                    yield _record([(row.as_py(), doc.as_py(), k, n, whole[at[k] : at[k + 1]])], names, kinds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for row in batch.to_pylist():
                packed = own.leaf(row.pop("text"))
                yield _record([(*row.values(), *packed)], [*row, "ids", "starts"], [pa.int64()] * 4 + [pa.binary()] * 2)

    def join(group: pa.Table) -> pa.Table:
        own = encoder(path)
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        part = own.tree([_read(r["ids"], r["starts"]) for r in rows])
        row = rows[0]
        up = (row["row"], row["doc_id"], row["part"] // FAN, -(-row["parts"] // FAN), _packed(part.ids), bytes(part.starts))
        return pa.Table.from_batches([_record([up], ["row", "doc_id", "part", "parts", "ids", "starts"], [pa.int64()] * 4 + [pa.binary()] * 2)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                packed = ids.as_py()
                yield _codes([(doc.as_py(), packed, own.decode(np.frombuffer(packed, dtype="<u4").tolist()))])

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    # written: the numbers of rows must not change when a task runs again
    leaves = written(numbered.mapInArrow(cut, "row long, doc_id long, part long, parts long, text string"))
    most = leaves.agg(F.max("parts")).first()[0] or 1
    nodes = leaves.repartition("row", "part").mapInArrow(encode, PARTS)
    while most > 1:
        nodes = nodes.groupBy("row", F.floor(F.col("part") / FAN)).applyInArrow(join, PARTS)
        most = -(-most // FAN)
    return nodes.mapInArrow(decode, CODES)


def encoded(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers, and the text that they give."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    return _short(own.where(size <= leaf), path).unionAll(_long(own.where(size > leaf), path, leaf))


def id_array(packed: Column) -> Column:
    """The ids as an array of integers."""
    one = lambda i: sum(
        F.conv(F.hex(F.substring(packed, i * 4 + k + 1, F.lit(1))), 16, 10).cast("int") * (1 << 8 * k) for k in range(4)
    )
    return F.when(F.length(packed) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.length(packed) / 4).cast("int") - 1), one)
    )


def digests(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encoded(docs, path, leaf).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
