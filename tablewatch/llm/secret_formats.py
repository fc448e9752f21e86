"""Secret scan by grammar inference.

Credentials found by their context or fixed mark are labelled examples. Per kind, at most ``max_labelled``
of them (first by a hash, so the choice does not depend on partitioning) are written as strings over
character classes and put into a prefix tree. States whose outgoing frequencies do not differ by a Hoeffding
bound are merged, recursively, into a probabilistic automaton that accepts unseen strings of the same
format. Every candidate token of every document is then scored: the mean log-likelihood per character under
the best automaton, less that under an automaton of ordinary tokens. Tokens that hold letters and digits and
score like the labelled ones are added as ``format`` spans; spans found by context always stay.

Rows: a null or empty text has no spans. A null doc_id and repeated rows are kept as they are. Without any
labelled credential no span is added. Extra columns are ignored; an empty table gives an empty result.
Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewatch.llm.shared import written

KINDS = ("assign", "access", "hex")
MAX_LABELLED = 400
ALPHA = 0.05  # of the Hoeffding test
QUANTILE = 0.02  # of the labelled scores of a kind is its bar

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_CUES = ("passw", "secret", "token", "api")
_HEX = re.compile(r"[0-9a-f]{16,}+")  # possessive, so a match is a whole run
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}+")

# Character classes of the automata, one letter each; anything else counts as a mark.
_CLASS = {chr(c): "d" for c in range(48, 58)} | {chr(c): "h" for c in range(97, 103)} | {chr(c): "l" for c in range(103, 123)}
_CLASS |= {chr(c): "H" for c in range(65, 71)} | {chr(c): "L" for c in range(71, 91)}
SYMBOLS = "dhlHLm$"  # $ ends a string


def classes(token: str) -> str:
    return "".join(_CLASS.get(ch, "m") for ch in token)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the spans found by context or mark, by start, then kind."""
    out = []
    low = text.lower()
    if any(cue in low for cue in _CUES):
        out += [(*m.span(), "assign", m.group(1)) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access", m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(*m.span(), "hex", m.group()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Tokens with a letter and a digit."""
    if not _DIGIT.search(text):
        return
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not token.isalpha() and any(ch.isdigit() for ch in token) and any(ch.isalpha() for ch in token):
            yield (*m.span(), token)


@dataclass
class Automaton:
    """A probabilistic automaton: per state its counts and successors by symbol."""

    counts: list[Counter] = field(default_factory=list)
    moves: list[dict[str, int]] = field(default_factory=list)

    def state(self) -> int:
        self.counts.append(Counter())
        self.moves.append({})
        return len(self.counts) - 1

    def likelihood(self, word: str) -> float:
        """Mean log-likelihood per symbol; unseen symbols count half an occurrence, and an unseen move starts anew."""
        total, at = 0.0, 0
        for symbol in [*word, "$"]:
            seen = self.counts[at]
            total += math.log((seen[symbol] + 0.5) / (seen.total() + 0.5 * len(SYMBOLS)))
            at = self.moves[at].get(symbol, 0)
        return total / (len(word) + 1)


def _prefix_tree(words: list[str]) -> Automaton:
    tree = Automaton()
    tree.state()
    for word in words:
        at = 0
        for symbol in word:
            tree.counts[at][symbol] += 1
            if symbol not in tree.moves[at]:
                new = tree.state()
                tree.moves[at][symbol] = new
            at = tree.moves[at][symbol]
        tree.counts[at]["$"] += 1
    return tree


def _differ(a: Counter, b: Counter, alpha: float) -> bool:
    n, m = a.total(), b.total()
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    return any(abs(a[s] / n - b[s] / m) > bound for s in a.keys() | b.keys())


def _alike(auto: Automaton, x: int, y: int, alpha: float) -> bool:
    """Whether two states and all their common successors are statistically compatible."""
    todo, seen = [(x, y)], set()
    while todo:
        p, q = todo.pop()
        if p == q or (p, q) in seen:
            continue
        seen.add((p, q))
        if auto.counts[p].total() and auto.counts[q].total() and _differ(auto.counts[p], auto.counts[q], alpha):
            return False
        todo += [(auto.moves[p][s], auto.moves[q][s]) for s in auto.moves[p].keys() & auto.moves[q].keys()]
    return True


def _fold(auto: Automaton, keep: int, tree: int) -> None:
    """Add a subtree's counts to the states it meets from ``keep`` on."""
    todo = [(keep, tree)]
    while todo:
        p, q = todo.pop()
        auto.counts[p].update(auto.counts[q])
        for symbol, child in auto.moves[q].items():
            if symbol in auto.moves[p]:
                todo.append((auto.moves[p][symbol], child))
            else:
                auto.moves[p][symbol] = child


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the words' prefix tree, those near the root first."""
    auto = _prefix_tree(words)
    kept, border = [0], sorted(auto.moves[0].items())
    border = [(0, s, child) for s, child in border]
    while border:
        # the successor reached most often has the most certain frequencies
        border.sort(key=lambda b: (auto.counts[b[2]].total(), -b[2]))
        parent, symbol, child = border.pop()
        target = next((k for k in kept if _alike(auto, k, child, alpha)), None)
        if target is None:
            kept.append(child)
            border += [(child, s, c) for s, c in sorted(auto.moves[child].items())]
            continue
        auto.moves[parent][symbol] = target
        _fold(auto, target, child)
        red = set(kept)
        border = [(k, s, c) for k in kept for s, c in sorted(auto.moves[k].items()) if c not in red]
    number = {old: new for new, old in enumerate(kept)}
    return Automaton([auto.counts[k] for k in kept], [{s: number[c] for s, c in auto.moves[k].items()} for k in kept])


@dataclass
class Formats:
    automata: dict[str, Automaton]
    ordinary: Automaton
    bars: dict[str, float]

    def score(self, token: str) -> tuple[float, bool]:
        """Best score over the formats, less the ordinary one, and whether it passes that format's bar."""
        best, passes = -math.inf, False
        # a token without small letters may be the capital form of a format
        for word in {classes(token), classes(token.lower() if token.upper() == token else token)}:
            plain = self.ordinary.likelihood(word)
            for kind, auto in self.automata.items():
                own = auto.likelihood(word) - plain
                best, passes = max(best, own), passes or own >= self.bars[kind]
        return best, passes


def learn(labelled: dict[str, list[str]], ordinary: list[str]) -> Formats:
    automata = {k: infer([classes(t) for t in tokens]) for k, tokens in labelled.items() if tokens}
    plain = infer([classes(t) for t in ordinary]) if ordinary else infer(["l"])
    bars = {}
    for kind, auto in automata.items():
        scores = sorted(auto.likelihood(classes(t)) - plain.likelihood(classes(t)) for t in labelled[kind])
        bars[kind] = max(0.0, scores[int(QUANTILE * (len(scores) - 1))])
    return Formats(automata, plain, bars)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, tokens = [], []
        for text in batch.column(0):
            text = text.as_py() or ""
            own = base_spans(text)
            kinds += [s[2] for s in own]
            tokens += [s[3] for s in own]
            if m := _TOKEN.search(text):  # ordinary tokens are plentiful; one of a document will do
                if m.group().isalpha() or not any(a <= m.start() < b for a, b, *_ in own):
                    kinds.append("ordinary")
                    tokens.append(m.group())
        yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(tokens, pa.string())], names=["kind", "token"])


def labelled_tokens(docs: DataFrame, max_labelled: int) -> dict[str, list[str]]:
    """At most ``max_labelled`` distinct tokens of each kind."""
    found = written(docs.select(F.col("text").cast("string")).mapInArrow(_examples, "kind string, token string")).distinct()
    out = {}
    for kind in (*KINDS, "ordinary"):
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("token"), "token").limit(max_labelled).select("token")
        out[kind] = [r["token"] for r in rows.collect()]
    return out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, top_score double"


def scan(text: str, formats: Formats) -> tuple:
    base = base_spans(text)
    told = [f"{kind}:{a}:{b}" for a, b, kind, _ in base]
    scores = [formats.score(token)[0] for *_, token in base] if formats.automata else []
    added = []
    if formats.automata:
        taken = [(a, b) for a, b, *_ in base]
        for a, b, token in candidates(text):
            if any(x < b and a < y for x, y in taken):
                continue
            score, passes = formats.score(token)
            scores.append(score)
            if passes:
                added.append((a, b, "format"))
    every = sorted([s[:3] for s in base] + added, key=lambda s: (s[0], (*KINDS, "format").index(s[2])))
    count = Counter(s[2] for s in every)
    return (
        *(count[k] for k in KINDS), hashlib.sha256(",".join(told).encode()).hexdigest(),
        ",".join(f"{k}:{a}:{b}" for a, b, k in every), count["format"], max(scores, default=None),
    )


def secrets(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Counts, digest of the base spans, all spans and the best format score of every row."""
    known = labelled_tokens(docs, max_labelled)
    formats = learn({k: known[k] for k in KINDS}, known["ordinary"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
        for batch in batches:
            own = [scan(text.as_py() or "", formats) for text in batch.column(1)]
            columns = [pa.array([r[i] for r in own], t) for i, t in enumerate(types)]
            yield pa.record_batch([batch.column(0), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCHEMA)
