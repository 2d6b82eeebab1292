import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from terravane.llm import bpe


@pytest.fixture(scope="module")
def pair():
    path = P.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.Codec(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, t):
    return np.frombuffer(codec.encode(t), "<u4").tolist()


def test_equals_the_library(pair):
    codec, enc = pair
    rnd = random.Random(1)
    tokens = list(codec.fst.ranks)
    for k in range(4000):
        t = b"".join(rnd.choice(tokens) if k % 2 else bytes([rnd.randrange(256)]) for _ in range(rnd.randint(1, 8))).decode("utf-8", "replace")
        assert ids(codec, t) == enc.encode_ordinary(t)
    for t in ("", " ", "\n\n x", "a" * 5000, " " * 4000 + "b", "日本語テキスト🎉" * 50, "<|endoftext|>", "it's we'll", "\x00\x01", "e\u0301"):
        assert ids(codec, t) == enc.encode_ordinary(t)


def test_every_token_and_bounded_states(pair, monkeypatch):
    codec, _ = pair
    for b, i in list(codec.fst.ranks.items())[::7]:
        assert codec.fst.encode(b) == i.to_bytes(4, "little")
    monkeypatch.setattr(bpe, "STATES", 50)
    small = bpe.Transducer(codec.fst.ranks)
    for w in (b"unfortunately", b"zzxqkjwv" * 9, b"antidisestablishmentarianism" * 3):
        assert small.encode(w) == codec.fst.encode(w)
    assert len(small.states) <= 51


def test_round_trip_and_streaming_decode(pair):
    codec, _ = pair
    t = "naïve café 🎉 " * 30000
    assert codec.decode_text(codec.encode(t)) == t
    raw = t.encode()[:5000]
    for step in (1, 2, 3, 7):
        m = bpe.Utf8Machine()
        assert "".join([*(m.feed(raw[i : i + step]) for i in range(0, len(raw), step)), m.end()]) == raw.decode("utf-8", "replace")
    rnd = random.Random(2)
    for _ in range(3000):
        raw = bytes(rnd.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0xFF]) for _ in range(rnd.randint(0, 9)))
        m = bpe.Utf8Machine()
        assert "".join([*(m.feed(raw[i : i + 1]) for i in range(len(raw))), m.end()]) == raw.decode("utf-8", "replace")


def test_frames(spark):
    rows = [(1, "hello world", 0), (1, None, 1), (None, "", 2)]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens, r.round_trip) for r in got] == [(1, 2, True), (1, 0, True), (None, 0, True)]
    assert got[1].ids_sha256 == empty and got[0].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
