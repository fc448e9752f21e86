"""The manifest against a plain tree."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from tablewatch.llm import merkle

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, lane STRING, pos STRING, path STRING, root STRING"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climbed(nodes):
    """Root of a list of hashes, and for each its siblings (left, right) by level."""
    paths, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for row in owners[at + k]:
                    paths[row].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            above.append([row for own in owners[at : at + 8] for row in own])
        nodes, owners = up, above
    return nodes[0], paths


def plain(rows):
    lanes = {}
    for i, text, lang, source, n in rows:
        seen = text
        if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
            seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        lanes.setdefault(lang, []).append((i, leaf(i, source, lang, n, text), leaf(i, source, lang, n, seen)))
    order = sorted(lanes, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lane in order:
        lanes[lane].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lane] = climbed([r[1] for r in lanes[lane]])
    if not order:
        return Counter()
    root, tops = climbed([trees[lane][0] for lane in order])
    out = Counter()
    for lane, top in zip(order, tops, strict=True):
        for (i, own, other), path in zip(lanes[lane], trees[lane][1], strict=True):
            acc, whole = other, path + top
            for left, right in whole:
                acc = h(left, acc, right)
            out[(i, own, trees[lane][0], root, h(*(a + b for a, b in whole)), acc, acc == root)] += 1
    return out


def rows_of(pick, sizes):
    out = []
    for lang, size in sizes.items():
        out += [(pick.randrange(10**6) - 5 * 10**5, pick.choice(["Abc É", "", "x", None, "ZZ\n"]), lang, pick.choice(["s", None]), pick.choice([3, None])) for _ in range(size)]
    return out


@pytest.mark.parametrize("sizes", [{"en": 700, None: 65, "": 8, "é": 9, "zz": 1, "de": 64}, {f"l{k}": k % 3 + 1 for k in range(19)}, {"en": 1}, {None: 2}, {}])
def test_equals_a_plain_tree(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "STRETCH", 16)
    rows = rows_of(random.Random(3), sizes)
    if len(rows) > 100:
        rows += [rows[5], rows[5], (None, "Q", "en", "s", 1), (rows[9][0], "another", rows[9][2], "s", 1), (7, "W" * 100_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(4)
    got = merkle.verified(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows)
