"""What the operators share: table access, byte views of Arrow text columns, hashes and words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.arrow import flat, pieces
from loam.session import discard, written

__all__ = ["discard", "flat", "pieces", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) alone, null texts as empty: other columns never meet an operator's own names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[k], starts[k] + 1, ... lens[k] of them for each k, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    some = lens > 0
    s, n = starts[some].astype(np.int64), lens[some].astype(np.int64)
    head = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=head[1:])
    out[0] = s[0]
    out[head[1:]] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


ODD = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and ODD ** -i modulo 2 ** 64 for i below n at least; kept up to 8 M entries."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, ODD, np.uint64), np.full(size, pow(ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 8 << 20:
            _powers[0] = have
    return have[0][:n], have[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with hash(data[i:j]) = (P[j] - P[i]) * ODD ** -i modulo 2 ** 64."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte string data[start : start + size].

    Its chunks of eight bytes, each mixed with its number, are summed and mixed with the size. Unlike a polynomial
    modulo 2 ** 64, for which long words of two alternating letters collide whatever the base, equal hashes of
    different strings are chance alone.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(data) + 8,), "<u8", buffer=padded, strides=(1,))
    start, size = start.astype(np.int64), size.astype(np.int64)

    def chunk(at: np.ndarray, left: np.ndarray, number: np.ndarray) -> np.ndarray:
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.clip(left, 1, 8)).astype(np.uint64))
        return mix((eight[at] & keep) ^ mix((number + 1 + seed * 0x10001).astype(np.uint64) * np.uint64(ODD)))

    out = chunk(start, size, np.zeros(1, np.int64))
    out[size == 0] = 0
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        number = np.arange(int(more.sum()), dtype=np.int64) - np.repeat(np.cumsum(more) - more, more) + 1
        owner = np.repeat(long, more)
        rest = chunk(start[owner] + 8 * number, size[owner] - 8 * number, number)
        out[long] += np.add.reduceat(rest, np.cumsum(more) - more)
    return mix(out + size.astype(np.uint64) * np.uint64(ODD))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word: digits, letters, and every byte of a character outside ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


class Words:
    """Words of several texts: begin and end (bytes), doc (text number), low (lower-cased bytes), hash of the lower-cased word, first (word number of each text's first word, n + 1 values).

    Places of bytes that are in no word, and at which words are cut, may be given.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, outside: np.ndarray | None = None, cuts: np.ndarray | None = None):
        low = LOWER[data]
        inside = IN_WORD[low]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if outside is not None:
            inside[outside] = False
        if cuts is not None:
            edge[cuts] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before &= ~edge[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.begin = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.low = low
        self.hash = hashes(low, self.begin, self.end - self.begin)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: (hashes, n + 1 offsets). A text of fewer words, but not none, is one shingle."""
    n = np.diff(words.first)
    per = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    start = ragged(words.first[:-1], per)
    doc = np.repeat(np.arange(len(n)), per)
    h = np.zeros(len(start), np.uint64)
    padded = np.r_[words.hash, np.zeros(width, np.uint64)]
    length = np.minimum(n, width)[doc]
    for k in range(width):
        h = np.where(k < length, mix(h * np.uint64(ODD) + padded[start + k]), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))
