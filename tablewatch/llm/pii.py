"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over the whole text and finds anchors: at-signs, schemes, digits, plus
signs and identifier cues. At an anchor a small deterministic parser expands left and right to the boundary
of an address or number and validates it (parts of an address, Luhn, length, mod 97). Every parser moves
forward only, so the time is linear in the text, however long one run of characters is.

Kinds found anywhere: ``email``, ``ip``, ``card``, ``phone``. Kinds the anchors add: ``masked`` (name (at)
host (dot) tld), ``login`` (user and password before the host of a URL), ``iban`` (after its cue, checked by
mod 97) and ``account`` (6 to 17 digits after a cue). Added spans never replace or cut the others.

Rows: a null or empty text has no spans. A null doc_id and repeated rows are kept as they are. Extra columns
are ignored; an empty table gives an empty result. Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("masked", "login", "iban", "account")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MASKED_HOST = re.compile(r"\x20?([A-Za-z0-9-]++)((?:\x20?[(\[](?:dot|DOT|Dot)[)\]]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++)")
_LOGIN = re.compile(r"[^\s/@:?#]++:[^\s/@?#]++@[A-Za-z0-9.-]++")
_IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20(?:no|nr|number|num|id))?[.:#]?\x20?#?([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.IGNORECASE | re.ASCII)

#: Anchors and the parser they call.
_CUES = {"iban": ("iban",), "account": ("account", "acct", "konto", "cuenta", "compte")}
_MASKS = ("(at)", "[at]", "(AT)", "[AT]", "(At)", "[At]")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in ("@", "+", *"0123456789"):
        a.add_word(word, (word if word in "@+" else "digit", 1))
    a.add_word("://", ("scheme", 3))
    for word in _MASKS:
        a.add_word(word, ("masked", len(word)))
    for kind, words in _CUES.items():
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _left(text: str, at: int, floor: int, allowed: frozenset[str]) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, each in order of its start and without overlaps within the kind."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys((*KINDS, "run"), 0)  # where the next match of a kind may begin
    for last, (what, length) in anchors.iter(text):
        at = last + 1 - length
        if what == "digit":
            if at < done["run"]:
                continue
            done["run"] = _DIGITS.match(text, at).end()
            if at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
                    found["ip"].append(m.span())
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "") if m.end() - at <= 40 else ""
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif what == "@":
            start = _left(text, at, done["email"], _LOCAL)
            if start < at and (m := _HOST.match(text, at + 1)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif what == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum("0" <= ch <= "9" for ch in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif what == "masked":
            end = at - 1 if at and text[at - 1] == " " else at
            start = _left(text, end, done["masked"], _LOCAL)
            if start < end and (m := _MASKED_HOST.match(text, last + 1)):
                done["masked"] = m.end()
                found["masked"].append((start, m.end()))
        elif what == "scheme":
            start = _left(text, at, done["login"], _SCHEME)
            if start < at and (m := _LOGIN.match(text, last + 1)):
                done["login"] = m.end()
                found["login"].append((start, m.end()))
        elif (not at or text[at - 1] not in _WORD) and at >= done[what]:
            m = (_IBAN if what == "iban" else _ACCOUNT).match(text, last + 1)
            if m and (what != "iban" or _mod97(m.group(1).replace(" ", ""))):
                done[what] = m.end(1)
                found[what].append(m.span(1))
    return found


def _told(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


SCHEMA = ", ".join(
    ["doc_id long", *(f"n_{k} long" for k in BASE), "base_sha256 string", "spans string", *(f"n_{k} long" for k in ADDED)]
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        out: list[list] = [[] for _ in range(len(KINDS) + 2)]
        for text in batch.column(1):
            found = find(text.as_py() or "", anchors)
            row = [*(len(found[k]) for k in BASE), hashlib.sha256(_told(found, BASE).encode()).hexdigest(), _told(found, KINDS), *(len(found[k]) for k in ADDED)]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * len(BASE) + [pa.string()] * 2 + [pa.int64()] * len(ADDED)
        yield pa.record_batch(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
            names=[part.split()[0] for part in SCHEMA.split(", ")],
        )


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_rows, SCHEMA)
