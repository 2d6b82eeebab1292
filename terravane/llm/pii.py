"""PII: regular expressions propose spans, checksum validators confirm them, context words near a span adjust its score.

A span has a kind, a start, an end (code points, end exclusive) and a score. Base spans (email, ip, card and phone by
the contract's patterns) always stay; the method adds IBANs that pass mod-97, mail addresses written with "at" and
"dot", and social security numbers and short cards which need a context word. One scan of the documents, no shuffle;
every pattern is linear in the text, so a very long text costs what many short ones do.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: What each kind scores before context, what a passed checksum adds, and the words that raise a score.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.3}
CHECKED = 0.4
CONTEXT = {
    "email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security"),
}
CONTEXT_CHARS, CONTEXT_ADDS, THRESHOLD = 40, 0.3, 0.6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Nothing can match from within a run of digits if it doesn't from the run's start, so only starts are tried: linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}) ?[(\[]at[)\]] ?([A-Za-z0-9-]{1,63}(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+)", re.IGNORECASE)
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    rest = 0
    for c in s:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @."""
    done, at = 0, t.find("@")
    while at >= 0:
        nxt = at + 1
        if at > done and t[at - 1] in LOCAL and (m := DOMAIN.match(t, at + 1)):
            s = at - 1
            while s > done and t[s - 1] in LOCAL:
                s -= 1
            yield s, m.end()
            done = nxt = m.end()
        at = t.find("@", nxt)


def ips(t: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(t):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def cards(t: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(t):
        if m.end() - m.start() <= 37 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def phones(t: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def context(t: str, kind: str, s: int, e: int) -> float:
    """What words near the span add."""
    near = t[max(0, s - CONTEXT_CHARS) : s].lower() + " " + t[e : e + CONTEXT_CHARS // 2].lower()
    return CONTEXT_ADDS if any(w in CONTEXT[kind] for w in re.findall("[a-z]+", near)) else 0.0


def proposals(t: str) -> Iterator[tuple[str, int, int, bool]]:
    """Spans beyond the base ones: kind, start, end and whether a checksum confirmed it."""
    for m in IBAN.finditer(t):
        end = m.end()
        while end - m.start() >= 15:  # words that follow may have been taken along: give groups back until mod-97 holds
            code = t[m.start() : end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                yield "iban", m.start(), end, True
                break
            end = t.rfind(" ", m.start(), end)
    for m in SPELT.finditer(t):
        yield "email", m.start(), m.end(), True
    for m in SSN.finditer(t):
        yield "ssn", m.start(), m.end(), False
    for m in CARD.finditer(t):
        if m.end() - m.start() <= 30 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 15 and luhn(d):
            yield "card", m.start(), m.end(), False


class Taken:
    """Stretches of a text that spans have taken; those that overlap are one. Asking is a search by bisection."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        i = bisect_right(self.ends, s)
        return i == len(self.ends) or self.starts[i] >= e

    def add(self, s: int, e: int) -> None:
        """A stretch that is free."""
        insort(self.starts, s)
        insort(self.ends, e)


def find(text: str | None) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int, int]]]:
    """All spans with scores, and the base ones, in order of kind, then start. Null text has none."""
    t = text or ""
    base = [(k, s, e) for k in BASE for s, e in FINDERS[k](t)]
    score = lambda k, s, e, ok: min(1.0, PRIOR[k] + CHECKED * ok + context(t, k, s, e))
    spans = [(k, s, e, score(k, s, e, k == "card")) for k, s, e in base]
    taken = Taken((s, e) for _, s, e in base)
    for k, s, e, ok in proposals(t):
        if taken.free(s, e) and (p := score(k, s, e, ok)) >= THRESHOLD:
            spans.append((k, s, e, p))
            taken.add(s, e)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])), base


def joined(spans) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<kind, start, end, score>>, and the digest columns of the base spans.

    Null or empty text gives an empty list and zeros; ids may repeat or be null, each row is answered on its own; other
    columns are not read. Order of spans: kind as listed, then start.
    """
    ship(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            cols = {k: [] for k in ("spans", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "joined")}
            for t in b.column(1).to_pylist():
                spans, base = find(t)
                cols["spans"].append([dict(zip(("kind", "start", "end", "score"), x)) for x in spans])
                for k in BASE:
                    cols[f"n_{k}"].append(sum(x[0] == k for x in base))
                cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols["joined"].append(joined(spans))
            arrays = [b.column(0), pa.array(cols["spans"], span), *(pa.array(cols[f"n_{k}"], pa.int64()) for k in BASE), pa.array(cols["base_sha256"], pa.string()), pa.array(cols["joined"], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "spans", *(f"n_{k}" for k in BASE), "base_sha256", "joined"])

    d = docs.select(id_col, text_col)
    kind = d.schema[id_col].dataType.simpleString()
    return d.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, joined string")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    d = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.selectExpr("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "joined AS spans")
