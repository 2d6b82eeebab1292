"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

Encoding. The merges are compiled into a finite-state transducer that reads bytes and emits tokens. After any prefix of
a piece, the encoding of that prefix ends in one token, which the last token before it must tolerate: two adjacent
tokens are valid when no merge across their border comes before the merges that formed them. So a state holds, for each
position at which a later token may still begin, the token that ends there and the tokens up to it that are not yet
emitted. A byte adds a position; what every continuation agrees on is emitted. Only positions from which the vocabulary
has a longer token that fits there can still matter, so the lookahead is bounded by the longest token, and tokens that
tolerate the same of those longer tokens count as one. States and arcs are made when first met and dropped when their
number reaches a bound. A piece seen before is answered from a bounded memo of the transducer's own outputs.

Decoding streams: tokens go through an incremental UTF-8 state machine, a table of eight states, that holds back at most
three bytes of an unfinished character and replaces malformed ones; its way over a token is kept, so that most tokens
cost one lookup.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .common import KEPT, give_back

VOCABULARY = "byte_bpe_50k.tiktoken"
STATES, PIECES, PAIRS = 100_000, 200_000, 400_000  # bounds of the states, of the memo and of the decoder's pairs in one worker
STANDS, BARS = 150_000, 10_000  # and of the tokens found alike and of those whose bars are kept
ROWS = 256  # rows encoded at a time
LONGER = 32  # up to so many tokens with one beginning, states behind tokens that tolerate the same of them are one state


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def pack(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join(i.to_bytes(4, "little") for i in ids)


class State(dict):
    """Byte to (next state, packed ids emitted on the way). An arc is made when first followed.

    alive: the positions in pending at which a later token may still begin, its end included. For each of them, before is
    the token that ends there, or one alike, and owed the packed ids up to it that are not emitted. The first is 0.
    """

    __slots__ = ("fst", "pending", "alive", "before", "owed")

    def __init__(self, fst: Transducer, pending: bytes, alive: tuple[int, ...], before: tuple[int, ...], owed: tuple[bytes, ...]):
        super().__init__()
        self.fst, self.pending, self.alive, self.before, self.owed = fst, pending, alive, before, owed

    def __missing__(self, byte: int) -> tuple[State, bytes]:
        fst, w = self.fst, self.pending + bytes((byte,))
        alive, before, owed, end = [], [], [], None
        for s, a, ids in zip(self.alive, self.before, self.owed):
            x = w[s:]
            if end is None:  # exactly one of the tokens that end here fits what stands before it
                t = fst.ranks.get(x)
                if t is not None and (a < 0 or fst.fitting(a, (t,))):
                    end = (t, ids + pack((t,)))
            a = fst.alike(a, x)
            if a is not None:
                alive.append(s)
                before.append(a)
                owed.append(ids)
        alive.append(len(w))
        before.append(end[0])
        owed.append(end[1])
        # What all live positions agree on is emitted, and what stands before the first of them is forgotten.
        first, lo, hi, cut = alive[0], min(owed), max(owed), 0
        while cut < len(lo) and lo[cut : cut + 4] == hi[cut : cut + 4]:
            cut += 4
        if first:
            w, alive = w[first:], [x - first for x in alive]
        arc = self[byte] = (fst.state(w, tuple(alive), tuple(before), tuple([x[cut:] for x in owed])), lo[:cut])
        return arc


class Transducer:
    """Bytes of one piece in, packed ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longer: dict[bytes, list[int]] = {}  # proper prefixes of tokens, each with its tokens, LONGER + 1 of them at most
        self.joins: dict[int, dict[int, int]] = {}  # left token to right token to what both form, lowest rank first
        for t, b in sorted(self.token.items()):
            for k in range(1, len(b)):
                of = self.longer.setdefault(b[:k], [])
                if len(of) <= LONGER:
                    of.append(t)
                left, right = ranks.get(b[:k]), ranks.get(b[k:])
                if left is not None and right is not None:
                    self.joins.setdefault(left, {})[right] = t
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[int, list[tuple[int, float]]] = {}  # of t to the left, of ~t to the right
        self.bars: dict[int, dict[int, int]] = {}
        self.stands: dict[tuple[int, bytes], int | None] = {}
        self.classes: dict[tuple, int] = {}
        self.states: dict[tuple, State] = {}
        self.start = State(self, b"", (0,), (-1,), (b"",))

    def half(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge forms t; None for a single byte and for what no merges form."""
        if t not in self.halves:
            b = self.token[t]
            parts = [b[i : i + 1] for i in range(len(b))]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(parts[i] + parts[i + 1])
                    if r is not None and r < t and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[t]

    def spine(self, t: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stand at t's border as t is formed, each with the rank at which a merge swallows it."""
        key = ~t if right else t
        if key not in self.spines:
            out, until = [], float("inf")
            while True:
                out.append((t, until))
                h = self.half(t)
                if h is None:
                    break
                t, until = h[right], t
            self.spines[key] = out
        return self.spines[key]

    def barred(self, a: int) -> dict[int, int]:
        """What may not stand at the border behind a, each with the lowest rank at which something of a merges with it."""
        got = self.bars.get(a)
        if got is None:
            if len(self.bars) >= BARS:
                self.bars.clear()
            got = self.bars[a] = {}
            for x, gone in self.spine(a, True):
                for y, r in self.joins.get(x, {}).items():
                    if r >= gone:
                        break
                    if r < got.get(y, gone):
                        got[y] = r
        return got

    def fitting(self, a: int, tokens) -> tuple[int, ...]:
        """Those of the tokens that stay apart from a right before them. Equal ranks merge from the left."""
        bars, spines, out = self.barred(a), self.spines, []
        for t in tokens:
            for y, gone in spines.get(t) or self.spine(t, False):
                r = bars.get(y)
                if r is not None and r <= gone:
                    break
            else:
                out.append(t)
        return tuple(out)

    def alike(self, a: int, x: bytes) -> int | None:
        """One token for all those that tolerate behind them the same of the tokens longer than x that begin with x, as a
        does; None where there are none. Where they are many, a stands for itself."""
        longer = self.longer.get(x)
        if longer is None or a < 0 or len(longer) > LONGER:
            return None if longer is None else a
        key = (a, x)
        if key not in self.stands:
            if len(self.stands) >= STANDS:
                self.stands.clear()
                self.classes.clear()
            fit = self.fitting(a, longer)
            self.stands[key] = self.classes.setdefault((x, fit), a) if fit else None
        return self.stands[key]

    def state(self, pending: bytes, alive: tuple[int, ...], before: tuple[int, ...], owed: tuple[bytes, ...]) -> State:
        """The state of this content, made when first met. At the bound all are forgotten; a walk under way goes on."""
        key = (pending, alive, before, owed)
        got = self.states.get(key)
        if got is None:
            if len(self.states) >= STATES:
                for x in self.states.values():
                    x.clear()
                self.states.clear()
                self.start.clear()
            got = self.states[key] = State(self, *key)
        return got

    def encode(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)
        if whole is not None:
            return pack((whole,))
        state, out = self.start, []
        for byte in piece:
            state, more = state[byte]
            if more:
                out.append(more)
        out.append(state.owed[-1])
        return b"".join(out)


class PieceMemo(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, fst: Transducer, most: int = PIECES):
        super().__init__()
        self.fst, self.most = fst, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self.fst.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self[piece] = out
        return out


#: Where a byte from lo to hi leads: (state, lo, hi, next state). 0 stands between characters; 1, 2 and 3 wait for so many
#: more bytes; 4 to 7 are behind E0, ED, F0 and F4, which limit the next byte.
UTF8_ARCS = (
    (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEC, 2), (0, 0xED, 0xED, 5), (0, 0xEE, 0xEF, 2),
    (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2),
    (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
)
REJECT = 8
UTF8_TABLE = [bytearray([REJECT]) * 256 for _ in range(8)]
for _state, _lo, _hi, _next in UTF8_ARCS:
    UTF8_TABLE[_state][_lo : _hi + 1] = bytes([_next]) * (_hi - _lo + 1)


class Utf8Machine:
    """Incremental UTF-8 by a table of states: feed bytes, get text. What cannot go on becomes one U+FFFD, and the byte
    that broke it is read anew; an unfinished character waits, three bytes at most. replaced counts the U+FFFD made."""

    def __init__(self, held: bytes = b""):
        self.held, self.state, self.replaced = b"", 0, 0
        if held:
            self.feed(held)

    def feed(self, b: bytes) -> str:
        if not self.state and b.isascii():
            return b.decode("ascii")
        state, held, out, i = self.state, bytearray(self.held), [], 0
        while i < len(b):
            nxt = UTF8_TABLE[state][b[i]]
            if nxt == REJECT:
                out.append("\ufffd")
                self.replaced += 1
                held.clear()
                i += state == 0
                state = 0
                continue
            held.append(b[i])
            state, i = nxt, i + 1
            if not state:
                code = held[0] & (0x7F if len(held) == 1 else 0x7F >> len(held))
                for x in held[1:]:
                    code = code << 6 | x & 0x3F
                out.append(chr(code))
                held.clear()
        self.state, self.held = state, bytes(held)
        return "".join(out)

    def end(self) -> str:
        """What an unfinished character at the end becomes."""
        rest = "\ufffd" if self.held else ""
        self.replaced += bool(self.held)
        self.held, self.state = b"", 0
        return rest


class TokenText(dict):
    """(bytes held back, token) to (text, bytes held back after, U+FFFD made): the UTF-8 machine's way over a whole token,
    made when first met, dropped at a bound."""

    def __init__(self, token: dict[int, bytes]):
        super().__init__()
        self.token = token

    def __missing__(self, key: tuple[bytes, int]) -> tuple[str, bytes, int]:
        if len(self) >= PAIRS:
            self.clear()
        m = Utf8Machine(key[0])
        text = m.feed(self.token[key[1]])
        got = self[key] = (text, m.held, m.replaced)
        return got


class Codec:
    def __init__(self, path: str, pattern: str):
        import numpy as np
        import regex

        self.fst = Transducer(load_ranks(path))
        self.pieces, self.memo = regex.compile(pattern), PieceMemo(self.fst)
        self.texts = TokenText(self.fst.token)
        # tokens of whole characters, for which the machine begins and ends between characters
        over = {i: self.texts[b"", i] for i in self.fst.token}
        self.plain = {i: text for i, (text, held, bad) in over.items() if not held and not bad}
        self.whole = np.zeros(max(self.fst.token) + 1, dtype=bool)
        self.whole[list(self.plain)] = True
        self.texts.clear()

    def encode(self, text: str | None) -> bytes:
        """Packed ids of the whole text; pieces are met in order, in slices that bound what is held."""
        out, part = [], []
        get = self.memo.__getitem__
        if text is None:
            return b""
        if len(text) < 200_000:
            return b"".join(map(get, self.pieces.findall(text)))
        for m in self.pieces.finditer(text):
            part.append(m[0])
            if len(part) >= 50_000:
                out.append(b"".join(map(get, part)))
                part = []
        return b"".join([*out, *map(get, part)])

    def decode(self, packed: bytes):
        """Chunks of (bytes, text) in order: the machine takes token after token, and where it holds nothing back and each
        token is whole characters, a chunk's texts are just joined."""
        import numpy as np

        ids, held, get = np.frombuffer(packed, "<u4"), b"", self.plain.__getitem__
        for k in range(0, len(ids), 1 << 16):
            part, began = ids[k : k + (1 << 16)], held
            out, at, replaced, part_ids = [], 0, 0, part.tolist()
            for odd in [*([0] if held else []), *np.flatnonzero(~self.whole[part]).tolist()]:
                if odd < at:
                    continue
                out += map(get, part_ids[at:odd])
                at = odd
                while at < len(part_ids) and (held or at == odd):
                    text, held, bad = self.texts[held, part_ids[at]]
                    out.append(text)
                    replaced, at = replaced + bad, at + 1
            out += map(get, part_ids[at:])
            text = "".join(out)
            if began or held or replaced:
                yield b"".join(map(self.fst.token.__getitem__, part_ids)), text
            else:
                yield text.encode("utf-8"), text
        if held:
            yield b"", "\ufffd"

    def verified(self, packed: bytes, text: str | None) -> tuple[str, bool]:
        """SHA-256 of the decoded bytes, and whether the decoded text, met chunk by chunk, is this text."""
        h, text, at, same = hashlib.sha256(), text or "", 0, True
        for x, t in self.decode(packed):
            h.update(x)
            same, at = same and text.startswith(t, at), at + len(t)
        return h.hexdigest(), same and at == len(text)

    def decode_text(self, packed: bytes) -> str:
        return "".join(t for _, t in self.decode(packed))


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    """One for a Python worker, until another operator's task runs there. Its many small long-lived dicts make frequent full
    collections costly."""
    usual = gc.get_threshold()

    def drop():
        codec.cache_clear()
        gc.set_threshold(*usual)
        gc.collect()  # states and transducer hold one another

    gc.set_threshold(200_000, 50, 100)
    KEPT.setdefault("bpe", drop)
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (array<int>, null unless asked for), ids_sha256, decoded_sha256 and round_trip (boolean).

    Null text is empty: no tokens. Each row is answered on its own, whatever its id; other columns are not read. The
    vocabulary is a path that every executor has (a rank file of the installed package by default).
    """
    ship(docs.sparkSession)
    own = default_vocabulary()
    path, pat = vocabulary or own[0], pattern or own[1]
    import numpy as np

    def run(batches):
        give_back("bpe")
        c = codec(path, pat)
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            n, lists, a, z, same = [], [], [], [], []
            for t in b.column(1).to_pylist():
                packed = c.encode(t)
                digest, whole = c.verified(packed, t)
                n.append(len(packed) // 4)
                lists.append(np.frombuffer(packed, "<i4") if ids else None)
                a.append(hashlib.sha256(packed).hexdigest())
                z.append(digest)
                same.append(whole)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(a, pa.string()), pa.array(z, pa.string()), pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip"])
        c.memo.clear()
        give_back("bpe")

    d = docs.select(id_col, text_col)
    kind = d.schema[id_col].dataType.simpleString()
    return d.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    d = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ids=False)
    return d.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
