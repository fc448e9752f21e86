"""Joined BPE against the library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewatch.llm import joined_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCRAPS = [
    "'", "'re", "'s", "r", "e", "ll", " ", "  ", "\n", "\t", "　", " ", "é", "中文", "한국", "🙂", "👩‍👩‍👧", "́", "0", "17", "!", "!!", "...",
    "<|endoftext|>", "<|endof", "text|>", "<|", "|>", "a", "aaaa", "the", " the", "ing", "antidisestablishmentarianism", "==", "==" * 20, " " * 30, "ab" * 25, "9" * 40, "\x00", "\U000e0001",
]


@pytest.fixture(scope="module")
def own():
    return joined_bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_joined_parts_equal_the_whole(own, library):
    """Every cut of odd texts, as small as one character."""
    pick = random.Random(5)
    for trial in range(1500):
        text = "".join(pick.choices(SCRAPS if trial % 3 else pick.sample(SCRAPS, 3), k=pick.randint(1, 40)))
        n = pick.randint(2, 9)
        at = sorted([0, len(text), *(pick.randint(0, len(text)) for _ in range(n))])
        parts = [own.part(text[a:b]) for a, b in zip(at, at[1:])]
        got = own.tree(parts)
        assert got.ids == whole(library, text), (text, at)
        assert got.starts == own.part(text).starts, (text, at)


def test_windows_stay_small_in_unsplit_text(own, library, monkeypatch):
    """Tens of thousands of letters without a break: a join reads far less than its halves."""
    pick = random.Random(6)
    text = "".join(pick.choices("etaoinshrdlucmfwyp", k=40_000))
    seen = []
    part = own.part
    a, b = part(text[:20_000]), part(text[20_000:])
    monkeypatch.setattr(own, "part", lambda t: seen.append(len(t)) or part(t))
    assert own.join(a, b).ids == whole(library, text)
    assert max(seen) < 1_000


def test_rows(spark, library):
    pick = random.Random(7)
    texts = ["".join(pick.choices(SCRAPS, k=pick.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "x" * 5_000, " " * 3_000, "<|endoftext|>" * 200, texts[0]]
    rows = [(k if k % 9 else None, t, "a", b"b") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, decoded STRING, ids BINARY")
    got = joined_bpe.encoded(docs, PATH, leaf=7).withColumn("list", joined_bpe.id_array("ids")).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    want = [(i, whole(library, t or "")) for i, t, *_ in rows]
    want = [(i, np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)) for i, ids in want]
    assert sorted([(r.doc_id, bytes(r.ids), r.decoded) for r in got], key=key) == sorted(want, key=key)
    assert all(r.list == np.frombuffer(r.ids, dtype="<u4").tolist() for r in got)
    hashed = joined_bpe.digests(docs, PATH, leaf=7).collect()
    want = [(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, ids, t in want]
    assert sorted(map(tuple, hashed), key=str) == sorted(want, key=str)
    assert joined_bpe.digests(docs.limit(0), PATH).collect() == []


class Counting:
    """The library's tokenizer, with the code points that it was given."""

    def __init__(self, tokens):
        self.tokens, self.given = tokens, 0

    def __getattr__(self, name):
        return getattr(self.tokens, name)

    def encode(self, text, **options):
        self.given += len(text)
        return self.tokens.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.given += sum(map(len, texts))
        return self.tokens.encode_batch_fast(texts, **options)


def test_chunks_equal_the_whole_and_are_encoded_once(library, monkeypatch):
    """Odd texts through the table, as it fills and as it makes room; what it knows is not encoded again."""
    own, pick = joined_bpe.Encoder(PATH), random.Random(8)
    spaces = [" ", " ", "\n", "\r\n", "\u00a0", "\u180e", "\u200b", "\u3000", "\x1c", "\x85", "\ufeff", "\0", " 's", "'", "x", "ok.", "<|endoftext|>"]
    for trial in range(3000):
        text = "".join(pick.choices(spaces if trial % 2 else SCRAPS + spaces, k=pick.randint(0, 30)))
        if trial == 1500:
            monkeypatch.setattr(joined_bpe, "MAX_CHUNKS", 20)
        ids, decoded = own.codes(text)
        part = own.part(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole(library, text), repr(text)
        assert decoded == library.decode(whole(library, text), skip_special_tokens=False)
        assert own.leaf(text) == (ids, bytes(part.starts)), repr(text)
    monkeypatch.setattr(joined_bpe, "MAX_CHUNKS", 1000)
    text = " ".join(pick.choices(["some", "words", "again,", "and\nagain"], k=5_000)) + " " + "long" * 100
    own.tokens = Counting(own.tokens)
    assert own.codes(text) == own.codes(text) and own.leaf(text)[0] == own.codes(text)[0]
    assert own.tokens.given < 2_000
    assert all(len(c) <= joined_bpe.LONG for t in (own.known_codes, own.known_parts) for c in [*t.now, *t.before])


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        joined_bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
