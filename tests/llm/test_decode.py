from terravane.llm import bpe


def test_round_trip_goes_through_the_utf8_machine(monkeypatch):
    c = bpe.codec(*bpe.default_vocabulary())
    text = "naïve 🙂 text 漢字 " * 40_000  # more than one chunk of ids
    packed = c.encode(text)
    assert len(packed) > 4 << 16
    digest, same = c.verified(packed, text)
    assert same and digest == bpe.hashlib.sha256(text.encode()).hexdigest()
    for other in (text[:-1], text + " ", text.replace("🙂", "🙁", 1), None):
        assert not c.verified(packed, other)[1]
    assert c.verified(b"", None)[1] and c.verified(b"", "")[1]
    c.texts.clear()
    monkeypatch.setattr(bpe.Utf8Machine, "feed", lambda self, b: "")
    assert not c.verified(packed, text)[1]
    c.texts.clear()


def test_malformed_ids_hash_the_bytes_of_their_tokens():
    """Ids that no text gives: unfinished and broken characters, also across the chunks of ids."""
    import random

    c, rnd = bpe.codec(*bpe.default_vocabulary()), random.Random(5)
    odd = [i for i in c.fst.token if not c.whole[i]]
    for n in (1, 2, 7, 60, (1 << 16) + 3):
        for _ in range(20 if n < 100 else 1):
            ids = [rnd.choice(odd) if rnd.random() < 0.4 else rnd.randrange(50_000) for _ in range(n)]
            raw = b"".join(c.fst.token[i] for i in ids)
            assert c.decode_text(bpe.pack(ids)) == raw.decode("utf-8", "replace")
            assert c.verified(bpe.pack(ids), "")[0] == bpe.hashlib.sha256(raw).hexdigest()
