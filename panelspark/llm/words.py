"""Word and hash helpers shared by the text operators; every function works on whole texts."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z, nothing else
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: the same, and every ASCII byte that is neither letter nor digit becomes a space
ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
SPACE = 32


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null counts as empty."""
    return b"" if text is None else text.encode()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the entropy of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                for b in (self.base, self.inverse)
            )
        return self.up, self.down


POWERS = Powers()


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums of a byte array, one longer than it."""
    up, _ = POWERS.upto(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of the bytes in [start, end); equal bytes give equal hashes wherever they stand."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


class Words:
    """The words of several texts side by side: hashes, places and the text each belongs to.

    ``texts`` are byte strings whose words are already separated by spaces alone.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts) + b" "
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        word = np.empty(len(buf) + 1, dtype=bool)
        word[0], word[1:] = False, buf != SPACE
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        first_byte = np.concatenate([[0], np.cumsum(lengths)])
        #: words of text i are first[i] .. first[i + 1] - 1
        self.first = np.searchsorted(self.start, first_byte)
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        self.hash = range_hash(prefix_hash(buf), self.start, self.end)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; entries that leave their text are meaningless."""
        n = len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            out[: max(0, n - i)] += mix(self.hash[i:] + np.uint64(i + 1))
            out = out * np.uint64(BASE) if i + 1 < k else out
        return mix(out + np.uint64(k))

    def fits(self, k: int) -> np.ndarray:
        """Whether k words from this one on stay in its text."""
        return np.arange(len(self.hash)) + k <= self.first[self.owner + 1]

    def joined(self, lo: int, hi: int) -> bytes:
        """Words lo .. hi - 1, one space between them."""
        return b" ".join(self.raw[self.start[lo] : self.end[hi - 1]].split()) if hi > lo else b""


def chunks(texts: list, size: int, limit: int = 1 << 20):
    """Index ranges of ``texts`` whose ``size`` adds up to about ``limit``; one long text may exceed it."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + size(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += size(t)
    if lo < len(texts):
        yield lo, len(texts)


#: one row ``t``: the CRC-32 of every byte, for ``crc32_sql``
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::UBIGINT], list_transform(range(8), lambda k : 0::UBIGINT)),
      lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of an SQL string, next to the table ``crc_table``."""
    hexed = f"hex(encode({text}))"
    return (
        f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, length({hexed}) // 2), "
        f"lambda i : concat('0x', substr({hexed}, 2 * i + 1, 2))::UBIGINT)), "
        "lambda c, b : xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"
    )
