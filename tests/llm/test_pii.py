import hashlib
import random
import re

from terravane.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    fits = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x)), "phone": lambda x: 8 <= len(digits(x)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if fits[k](m[0])]


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(5)
    for _ in range(20000):
        t = "".join(rnd.choice("ab1.@-+ ()25é4") for _ in range(rnd.randint(0, 60)))
        assert pii.find(t)[1] == brute(t)
    card = "4111 1111-1111 1111"
    for t in (f"x {card} y", f"é {card}", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0255.01.1.1", "+1 (988) 555-2485.", "a@b", "a@b.c@d.e", "", "a@b.c.", "+" + "1" * 20):
        assert pii.find(t)[1] == brute(t)


def test_method_adds_and_keeps():
    spans, base = pii.find("Please transfer to account IBAN DE89 3704 0044 0532 0130 00 today, write john [at] mail [dot] com")
    assert base == [] and [s[0] for s in spans] == ["email", "iban"]
    assert pii.find("DE89 3704 0044 0532 0130 01")[0] == []
    assert [s[0] for s in pii.find("his social security number is 123-45-6789")[0]] == ["ssn"] and pii.find("part 123-45-6789")[0] == []
    t = "mail a.b@c.de or 10.0.0.1"
    spans, base = pii.find(t)
    assert [s[:3] for s in spans] == base


def test_long_texts_are_linear():
    for s in ("a", "1", "1.", "a@", "+1 ", "AB12 ", "1-"):
        pii.find(s * (200_000 // len(s)))


def test_frames(spark):
    rows = [(1, "a@b.co", "x"), (1, None, "y"), (None, "", "z"), (2, "ip 1.2.3.4", "w")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert [(r.doc_id, r.n_email, r.n_ip, r.joined) for r in got] == [(1, 1, 0, "email:0:6"), (1, 0, 0, ""), (None, 0, 0, ""), (2, 0, 1, "ip:3:10")]
    assert got[0].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_spans_of_both_sorts_are_linear():
    import time

    def took(n):
        t = "a@b.cc 123-45-6789 +1 202 555 0100 x (at) y dot com " * n
        began = time.process_time()
        pii.find(t)
        return time.process_time() - began

    took(50)
    assert took(4000) < 40 * took(400) + 0.5


def test_taken_stretches():
    t = pii.Taken([(5, 9), (1, 3), (8, 12)])
    assert (t.starts, t.ends) == ([1, 5], [3, 12]) and t.free(3, 5) and not t.free(2, 4) and not t.free(0, 20) and t.free(12, 13)
    t.add(3, 5)
    assert not t.free(4, 5) and not t.free(3, 4) and t.free(0, 1)
