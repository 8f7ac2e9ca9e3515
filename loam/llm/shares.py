"""Shares of the documents ask, once a key, whether other rows have it; the answers return to the share.

Rows are dealt to shares by a hash of their row number, which is their own whatever their id and text. A share asks
for each of its distinct keys once, in blocks packed by bucket of keys, and the answers go to its first row, hence to
the same share, where they arrive (rows sorted by number) before its other rows. So a key that a third of all rows
hold costs one question and one answer a share, and no table of keys goes through the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import flat, partitions, pieces, texts

#: Bytes of text of one share: what a task holds of its keys and answers grows with them.
SHARE_BYTES = 128 << 20
ASKED = "bucket int, number long, keys binary, many binary, rows binary, counts binary, times binary"


#: Stands for a null id in comparisons: such a row is the least document.
NO_ID = -(1 << 63)
#: Numbers that rows equal in id and text are dealt to, by their place in the input.
COPIES = 4096


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): row, a hash of id, text and place, tells rows apart. Where two still have one, both get the answers of their share, which costs memory alone."""
    rows = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.select(F.xxhash64("doc_id", "text", F.pmod(F.monotonically_increasing_id(), F.lit(COPIES))).alias("row"), "doc_id", "text")


def share_count(rows: DataFrame, share_bytes: int = SHARE_BYTES) -> int:
    """Shares of (doc_id, text): as many as the session has shuffle partitions, more where a share would exceed `share_bytes` of text."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(rows.sparkSession), math.ceil(total / share_bytes))


def least_row(key: np.ndarray, row: np.ndarray, many: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least row of each, whether it has several rows or was said to, and how often it occurs."""
    if not len(key):
        return key, row, many, times
    order = np.lexsort((row, key))
    key, row, many, times = key[order], row[order], many[order], times[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.append(first[1:], len(key)) - 1
    return key[first], row[first], (row[first] != row[last]) | np.logical_or.reduceat(many, first), np.add.reduceat(times, first)


def ascending(values: np.ndarray) -> bytes:
    """Packed ascending int64 values."""
    return zlib.compress(np.diff(values, prepend=np.int64(0)).tobytes(), 1)


def restored(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64))


def ask(batches: Iterator[pa.RecordBatch], buckets: int, keys_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], name_bytes: int = 8, least: bool = False, counted: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of (row number, share, text, id) -> ASKED. keys_of(data, offsets) gives keys (uint64) and their text numbers.

    number is the share's first row; rows and counts, where `least` asks for them, the least id of each key; times,
    where `counted` does, how often the share has it.
    """
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    lowest: dict[int, int] = {}
    for batch in batches:
        number, share, ids = (np.asarray(batch.column(c)) for c in (0, 1, 3))
        data, offsets = flat(batch.column(2))
        for i, j in pieces(offsets, 2 << 20):
            keys, text = keys_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            row, of = ids[i:j][text], share[i:j][text]
            for s in np.unique(share[i:j]).tolist():
                own = of == s
                held.setdefault(s, []).append(least_row(keys[own], row[own], np.zeros(int(own.sum()), bool), np.ones(int(own.sum()), np.int32)))
                first = int(number[i:j][share[i:j] == s].min())
                lowest[s] = min(lowest.get(s, first), first)
    for s, parts in held.items():
        key, row, many, times = least_row(*(np.concatenate(x) for x in zip(*parts)))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((row, bucket))
        key, row, many, times, bucket = key[order], row[order], many[order], times[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        rows: list[list] = [[] for _ in range(7)]
        for b in np.flatnonzero(np.diff(cut)).tolist():
            k, r = key[cut[b] : cut[b + 1]], row[cut[b] : cut[b + 1]]
            packed = np.ascontiguousarray(k // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :name_bytes]
            new = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if least else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(r))).astype(np.int32) if least else new.astype(np.int32)
            often = zlib.compress(times[cut[b] : cut[b + 1]].astype(np.int32).tobytes(), 1) if counted else b""
            for into, x in zip(rows, (b, lowest[s], packed.tobytes(), np.packbits(many[cut[b] : cut[b + 1]]).tobytes(), ascending(r[new]), zlib.compress(counts.tobytes(), 1), often)):
                into.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[2:])], names=["bucket", "number", "keys", "many", "rows", "counts", "times"])


def short(key: np.ndarray, buckets: int, name_bytes: int = 8) -> np.ndarray:
    """A key as its answer names it: with name_bytes below 8, keys that differ in their uppermost bits alone look equal."""
    if name_bytes == 8:
        return key
    return (key // np.uint64(buckets) & np.uint64((1 << 8 * name_bytes) - 1)) * np.uint64(buckets) + key % np.uint64(buckets)


def answer(batches: Iterator[pa.RecordBatch], buckets: int, name_bytes: int = 8, least: bool = False, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of the keys asked for, those that more than one row has: (number of the share's first row, packed keys[, packed least rows][, those of the keys that occur more than `most` times])."""
    parts = []
    for batch in batches:
        for bucket, number, keys, many, rows, counts, times in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(keys) // name_bytes
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :name_bytes] = np.frombuffer(keys, np.uint8).reshape(-1, name_bytes)
            flags = np.unpackbits(np.frombuffer(many, np.uint8))[:n].astype(bool)
            row = np.repeat(restored(rows), np.frombuffer(zlib.decompress(counts), np.int32)) if least else np.zeros(n, np.int64)
            often = np.zeros(n, np.int32) if most is None else np.frombuffer(zlib.decompress(times), np.int32)
            parts.append((wide.view(np.uint64).ravel() * np.uint64(buckets) + np.uint64(bucket), flags, row, np.full(n, number, np.int64), often))
    if not parts:
        return
    key, many, row, asker, often = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.lexsort((row, key)) if least else np.argsort(key, kind="stable")
    key, many, row, asker, often = key[order], many[order], row[order], asker[order], often[order]
    same = key[1:] == key[:-1]
    first = np.flatnonzero(np.r_[True, ~same]) if len(key) else np.zeros(0, np.int64)
    per = np.diff(np.append(first, len(key)))
    lowest = np.repeat(row[first], per)
    hot = np.repeat(np.add.reduceat(often.astype(np.int64), first) > most, per) if most is not None and len(key) else np.zeros(len(key), bool)
    many[1:] |= same
    many[:-1] |= same
    key, asker, lowest, hot = key[many], asker[many], lowest[many], hot[many]
    order = np.argsort(asker, kind="stable")
    key, asker, lowest, hot = key[order], asker[order], lowest[order], hot[order]
    first = np.flatnonzero(np.r_[True, asker[1:] != asker[:-1]]) if len(asker) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), np.append(first[1:], len(asker)).tolist()):
        values = {"number": pa.array(asker[a : a + 1], pa.int64()), "keys": pa.array([key[a:b].tobytes()], pa.binary())}
        if least:
            values["least"] = pa.array([lowest[a:b].tobytes()], pa.binary())
        if most is not None:
            values["hot"] = pa.array([key[a:b][hot[a:b]].tobytes()], pa.binary())
        yield pa.RecordBatch.from_pydict(values)
