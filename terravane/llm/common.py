"""Small things that several operators share: ASCII rules, hashing and column helpers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def lower_ascii(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased, as UTF-8. bytes.lower and bytes.split know only ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64's)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash(dict):
    """Word to 64-bit hash. The cache is emptied when it has grown to its bound."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Mask of the first n bytes of a little-endian word of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
LONG_WORD = 128


def hash_words(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z lower-cased: eight bytes at a time, mixed between, over all words at once.

    Words over LONG_WORD bytes are hashed one by one.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[b[: len(raw)]], prepend=True, append=True))
    start, size = edge[::2], edge[1::2] - edge[::2]
    eights = np.ndarray(len(raw) + 1, dtype="<u8", buffer=b, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix64((eights[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        at = 8
        while len(more):
            left = size[more] - at
            h[more] = mix64(h[more] * np.uint64(0xD6E8FEB86659FD93) + (eights[start[more] + at] & _FIRST[np.minimum(left, 8)]))
            more, at = more[left > 8], at + 8
    if (long := np.flatnonzero(size > LONG_WORD)).size:
        import xxhash

        for i in long:
            h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]])
    return h


#: What an operator holds in a Python worker from task to task: its name, and what lets go of it.
KEPT: dict[str, Callable[[], None]] = {}


def give_back(keep: str | None = None) -> None:
    """Return freed memory to the system: Python workers are kept between stages, and what they hold counts. What operators
    other than `keep` hold from task to task is let go of first."""
    import ctypes

    import pyarrow as pa

    for name in [k for k in KEPT if k != keep]:
        KEPT.pop(name)()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
