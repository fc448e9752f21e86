"""Personal data, secrets and pieces against plain scans of the same texts."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece

from tablewatch.llm import piece_table, pii, secret_formats

ROWS = "doc_id LONG, text STRING, spans STRING, ids STRING, n_hex STRING"
TEXTS = [
    (1, None), (2, ""), (3, "plain words"), (3, "plain words"), (None, "a@b.co"), (4, "x" * 50_000 + "@" + "1" * 50_000), (5, "  two  spaces ")
]

BASE_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def edge_rows(spark):
    return spark.createDataFrame([(i, t, "s", "i", "h") for i, t in TEXTS], ROWS)


def luhn(digits):
    doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_pii(text):
    out = {}
    for kind, pattern in BASE_PII.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_pii_base_spans_equal_a_plain_scan():
    pick = random.Random(3)
    parts = ["1", "23", "456", "0", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "%", "4111111111111111", "255", "é", "\n"]
    anchors = pii.automaton()
    for _ in range(5_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 30)))
        found = pii.find(text, anchors)
        assert {k: found[k] for k in pii.BASE} == plain_pii(text), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("ask Ann (at) mail (dot) example (dot) org", "masked", "Ann (at) mail (dot) example (dot) org"),
        ("ftp://user:word@host.org/x", "login", "ftp://user:word@host.org"),
        ("IBAN: DE89 3704 0044 0532 0130 00 now", "iban", "DE89 3704 0044 0532 0130 00"),
        ("account no: 12345678 is", "account", "12345678"),
    ],
)
def test_pii_added_spans(text, kind, span):
    found = pii.find(text, pii.automaton())[kind]
    assert [text[a:b] for a, b in found] == [span]


def test_pii_leaves_prose_and_false_cues_alone():
    for text in ("IBAN: DE88 3704 0044 0532 0130 00", "discount 123456789", "he said so", "accounts were open in 1999"):
        found = pii.find(text, pii.automaton())
        assert not any(found[k] for k in pii.ADDED), text


def test_pii_rows(spark):
    rows = pii.personal_data(edge_rows(spark)).collect()
    assert len(rows) == len(TEXTS)
    none = hashlib.sha256(b"").hexdigest()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].base_sha256 == by_id[2].base_sha256 == none
    assert by_id[None].n_email == 1 and by_id[None].spans == "email:0:6"
    assert pii.personal_data(edge_rows(spark).limit(0)).count() == 0


def plain_secrets(text):
    out = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(a, b, secret_formats.KINDS[k]) for a, k, b in sorted(out)]


def test_secret_base_spans_equal_a_plain_scan():
    pick = random.Random(5)
    parts = ["token", "API_KEY", "apikey", '"', "'", " ", "=", ":", "abcdef012345", "AKIA", "ABCD1234EFGH5678", "z", "-", "ſecret", "é"]
    for _ in range(5_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert [s[:3] for s in secret_formats.base_spans(text)] == plain_secrets(text), text


def credential(pick, length=24):
    return "sk_" + "".join(pick.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(length))


def test_states_that_do_not_differ_are_merged():
    pick = random.Random(7)
    words = [secret_formats.classes(credential(pick)) for _ in range(300)]
    tree = secret_formats._prefix_tree(words)
    merged = secret_formats.infer(words)
    assert len(merged.counts) < len(tree.counts) / 20
    fresh = [secret_formats.classes(credential(pick)) for _ in range(100)]
    plain = [secret_formats.classes(w) for w in ("understanding1", "2024-01-01T00-00", "chapter-12-section")]
    assert min(map(merged.likelihood, fresh)) > max(map(merged.likelihood, plain))


def test_secret_rows(spark):
    pick = random.Random(9)
    docs = [(k, f'words and token = "{credential(pick)}" here internationalisation') for k in range(200)]
    bare = credential(pick)
    docs += [(900, f"a bare {bare} in prose"), (901, "release-2024-notes-v12 is out"), (902, None), (903, ""), (None, "x")]
    rows = {r.doc_id: r for r in secret_formats.secrets(spark.createDataFrame([(*d, "z") for d in docs], "doc_id LONG, text STRING, token STRING")).collect()}
    assert len(rows) == len(docs)
    assert rows[0].n_assign == 1 and rows[0].spans.startswith("assign:10:")
    assert rows[900].spans == f"format:7:{7 + len(bare)}"
    assert rows[901].n_format == 0 and rows[902].spans == rows[903].spans == ""
    assert secret_formats.secrets(edge_rows(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(model):
    pick = random.Random(11)
    parts = [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "𝒳", "<s>", "<unk>", "<0x41>", "\x00", "漢字", "     ", "　", ".", "﻿"]
    table = piece_table.ChunkTable(model)
    for _ in range(5_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 12)))
        ids = model.encode(text)
        assert table.encode(text) == ids, text
        n, ids_hash, decoded_hash = table.digest(text)
        assert n == len(ids)
        assert ids_hash == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert decoded_hash == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_piece_table_stays_bounded(model, monkeypatch):
    monkeypatch.setattr(piece_table, "MAX_CHUNKS", 50)
    table = piece_table.ChunkTable(model)
    for k in range(40):
        text = " ".join(f"w{k}x{i}" for i in range(10))
        assert table.encode(text) == model.encode(text)
        assert len(table.rows) <= 50


def test_piece_rows(spark, model):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_table.digests(edge_rows(spark), path).collect()
    assert len(rows) == len(TEXTS) and {r.doc_id: r.n_tokens for r in rows}[1] == 0
    full = piece_table.encoded(edge_rows(spark), path).collect()
    assert [r.decoded for r in full] == [t or "" for _, t in TEXTS]
    assert full[0].spans == "s" and len(full[0].ids) == 0
    assert piece_table.digests(edge_rows(spark).limit(0), path).count() == 0
