"""Byte-level BPE: pre-tokens of many documents at once, merges replayed over the distinct ones, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm.common import flat, hashes, pieces, ragged, table, texts

NONE = np.int32(-1)


class Ranks:
    """A rank file: bytes of each token, and for each adjacent pair of tokens the token that it merges to."""

    def __init__(self, content: bytes):
        lines = [x.split() for x in content.splitlines() if x.strip()]
        self.token = {base64.b64decode(a): int(b) for a, b in lines}
        size = max(self.token.values()) + 1
        by_id: list[bytes] = [b""] * size
        for t, r in self.token.items():
            by_id[r] = t
        self.data = np.frombuffer(b"".join(by_id), np.uint8)
        self.first = np.r_[0, np.cumsum([len(t) for t in by_id])].astype(np.int64)
        self.byte = np.array([self.token[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in self.token.items():
            for k in range(1, len(t)):
                a, b = self.token.get(t[:k]), self.token.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.one = pairs
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[int(p)] for p in self.pair], np.int32)
        digits = [b"%d " % i for i in range(size)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_first = np.r_[0, np.cumsum([len(d) for d in digits])].astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token of each pair, -1 if it has none."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.merged[at], NONE)


_ranks: dict[str, Ranks] = {}


def ranks(content: bytes) -> Ranks:
    """Parsed once in each worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _ranks:
        _ranks.clear()
        _ranks[key] = Ranks(content)
    return _ranks[key]


def one_word(word: bytes, r: Ranks) -> list[int]:
    """The merges of one word, lowest rank first, then leftmost; for the rare words that replay() hands back.

    A heap of (rank, place) over linked neighbours: n log n for a word of n bytes.
    """
    ids = [int(r.byte[b]) for b in word]
    n = len(ids)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    rank = r.merge(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist() if n > 1 else []
    heap = [(k, i) for i, k in enumerate(rank) if k >= 0]
    heapq.heapify(heap)

    def pair(i: int) -> int:
        return r.one.get(ids[i] << 32 | ids[after[i]], -1) if i >= 0 and after[i] >= 0 else -1

    while heap:
        k, i = heapq.heappop(heap)
        if ids[i] < 0 or pair(i) != k:
            continue
        j = after[i]
        ids[i], ids[j] = k, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for p in (before[i], i):
            if (new := pair(p)) >= 0:
                heapq.heappush(heap, (new, p))
    return [x for x in ids if x >= 0]


def replay(data: np.ndarray, first: np.ndarray, r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many words (bytes data, n + 1 offsets): (ids, n + 1 offsets).

    The inverted index holds, for each merge, the positions at which its pair stands. Merges are applied in rank
    order, each at all its positions at once; only the two neighbours of a merged pair get new index entries.
    """
    n = len(data)
    sym = r.byte[data]
    after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
    lens = np.diff(first)
    after[first[1:][lens > 0] - 1] = -1
    before[first[:-1][lens > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    odd: list[np.ndarray] = []
    heap: list[int] = []

    def add(rank: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for k, at in zip(rank[np.r_[0, cut]].tolist() if len(cut) else [int(rank[0])], np.split(place, cut) if len(cut) else [place]):
            if k in index:
                index[k].append(at)
            else:
                index[k] = [at]
                heapq.heappush(heap, k)

    if n > 1:
        found = np.full(n, NONE, np.int32)
        has = after >= 0
        found[has] = r.merge(sym[has], sym[after[has]])
        places = np.flatnonzero(found >= 0)
        if len(places):
            add(found[places], places)
    while heap:
        rank = heapq.heappop(heap)
        held = index.pop(rank)
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        right = after[at]
        ok = (sym[at] >= 0) & (right >= 0)
        at, right = at[ok], right[ok]
        if not len(at):
            continue
        ok = r.merge(sym[at], sym[right]) == rank
        at, right = at[ok], right[ok]
        if not len(at):
            continue
        if len(at) > 1 and (right[:-1] == at[1:]).any():  # a run such as aaa: leftmost first
            keep, last = [], -1
            for a, b in zip(at.tolist(), right.tolist()):
                keep.append(a != last)
                if keep[-1]:
                    last = b
            at, right = at[keep], right[keep]
        sym[at], sym[right] = rank, NONE
        further = after[right]
        after[at] = further
        some = further >= 0
        before[further[some]] = at[some]
        left = before[at]
        some_left = left >= 0
        new_place = np.concatenate((left[some_left], at[some]))
        if len(new_place):
            new_rank = r.merge(sym[new_place], sym[after[new_place]])
            real = new_rank >= 0
            if real.any():
                new_place, new_rank = new_place[real], new_rank[real]
                low = new_rank <= rank
                if low.any():  # a merge that comes before the present one: order within the word decides
                    odd.append(new_place[low])
                new_place, keep = np.unique(new_place, return_index=True)
                add(new_rank[keep], new_place)
    alive = sym >= 0
    count = np.r_[0, np.cumsum(alive)]
    ids, bounds = sym[alive], count[first]
    if odd:
        words = np.unique(np.searchsorted(first, np.concatenate(odd), side="right") - 1)
        parts, sizes, done = [], np.diff(bounds), 0
        for w in words.tolist():
            own = one_word(data[first[w] : first[w + 1]].tobytes(), r)
            parts += [ids[done : bounds[w]], np.array(own, np.int32)]
            done = bounds[w + 1]
            sizes[w] = len(own)
        ids, bounds = np.concatenate([*parts, ids[done:]]), np.r_[0, np.cumsum(sizes)]
    return ids, bounds


#: Classes of characters in the pre-token pattern: other, letter, number, white space.
OTHER, LETTER, NUMBER, SPACE = range(4)
_classes: list[np.ndarray] = []
#: The pattern's contractions.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def classes() -> np.ndarray:
    if not _classes:
        import regex

        table = np.zeros(0x110000, np.uint8)
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, everything):
                a, b = m.span()
                table[[ord(c) for c in everything[a:b]]] = kind
        _classes.append(table)
    return _classes[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte place of each) of valid UTF-8."""
    place = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[place].astype(np.uint32)
    out = lead.copy()
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        p, b = place[wide], lead[wide]
        padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.uint32) & 0x3F
        one, two, three = padded[p + 1], padded[p + 2], padded[p + 3]
        out[wide] = np.where(b < 0xE0, (b & 0x1F) << 6 | one, np.where(b < 0xF0, (b & 0x0F) << 12 | one << 6 | two, (b & 0x07) << 18 | one << 12 | two << 6 | three))
    return out, place


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte place at which each pre-token of the texts begins.

    The matches of the pattern are runs of one class of characters, each with one blank before it if there is one,
    runs of white space less the last character that another run follows, and the contractions after a quote
    that opens its match.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    points, place = code_points(data)
    kind = classes()[points]
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(place, offsets)] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    begins = new.copy()
    end = np.append(new[1:], True) | edge[1:]
    space = kind == SPACE
    # the last character of a run of white space that a run of the same text follows stands alone, or joins it if it is a blank
    last = space & end & ~edge[1:]
    begins |= last
    follows = np.flatnonzero(last) + 1
    joined = points[follows - 1] == 32
    begins[follows[joined]] = False
    # contractions: a quote that opens a match, alone in its run, and what follows it
    quote = np.flatnonzero((points == 39) & begins & end)
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1]]
    if len(quote):
        padded = np.r_[points, np.zeros(2, np.uint32)]
        stop = np.r_[edge, np.ones(2, bool)]
        one, two = padded[quote + 1], padded[quote + 2]
        length = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            fits = one == ord(c[0])
            if len(c) == 2:
                fits &= (two == ord(c[1])) & ~stop[quote + 2]
            length[fits & (length == 0)] = len(c)
        quote, length = quote[length > 0], length[length > 0]
        begins[quote + 1] = False
        after = quote + length + 1
        within = after < n
        # what is left of the letters begins a match of its own
        begins[after[within]] |= kind[after[within]] != SPACE
    return place[begins]


def distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one occurrence of each distinct word, word number of each occurrence).

    The hash only groups: every occurrence is compared with the word that stands for it, and where that differs, all
    are grouped by their bytes. Occurrences lie one after the other in data.
    """
    _, sample, which = np.unique(key, return_index=True, return_inverse=True)
    words, first = data[ragged(start[sample], length[sample])], np.r_[0, np.cumsum(length[sample])]
    for i in range(0, len(start), 1 << 18):
        w, n = which[i : i + (1 << 18)], length[i : i + (1 << 18)]
        if not np.array_equal(length[sample][w], n) or not np.array_equal(words[ragged(first[w], n)], data[start[i] : start[i] + n.sum()]):
            break
    else:
        return sample, which
    number: dict[bytes, int] = {}
    raw = data.tobytes()
    which = np.array([number.setdefault(raw[a : a + n], len(number)) for a, n in zip(start.tolist(), length.tolist())], np.int64)
    return np.unique(which, return_index=True)[1], which


def encode_texts(data: np.ndarray, offsets: np.ndarray, r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids, n + 1 offsets) of several texts: distinct pre-tokens are merged once and dealt back to their places."""
    starts, lens, keys = [], [], []
    for i, j in pieces(offsets, 1 << 20):  # bounds the memory of the character work
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s = pretokens(part, own)
        e = np.append(s[1:], len(part)).astype(np.int64)
        if len(s):
            keys.append(hashes(part, s, e - s))
            starts.append(s + offsets[i])
            lens.append(e - s)
    if not starts:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    start, length, key = np.concatenate(starts), np.concatenate(lens), np.concatenate(keys)
    sample, which = distinct(data, start, length, key)
    words = data[ragged(start[sample], length[sample])]
    first = np.r_[0, np.cumsum(length[sample])]
    ids, bounds = replay(words, first, r)
    count = np.diff(bounds)[which]
    out = ids[ragged(bounds[which], count)]
    sizes = np.r_[0, np.cumsum(count)]
    return out, sizes[np.searchsorted(start, offsets)]


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, by the ranks of a tiktoken file, without special tokens.

    A task takes a batch of documents, finds the distinct pre-tokens of the batch and replays the merges over them;
    nothing is shuffled, and a batch is bounded by Arrow's batch size. Null text is empty and has no ids. An empty
    table gives no rows, repeated rows are encoded each, other columns of docs are ignored.
    """
    with open(ranks_path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size is fixed

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(content.value)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets, 5 << 20):
                ids, bounds = encode_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], r)
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), column], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(task, "doc_id long, ids array<int>")


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[at[0] : at[-1]], at - at[0]


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, bytes binary) of token ids; null ids give no bytes."""
    with open(ranks_path, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(content.value)
        for batch in batches:
            for i in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(i, 1000)
                text, bounds = decoded(*lists(part.column(1)), r)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([text[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, bytes binary")


def decoded(ids: np.ndarray, bounds: np.ndarray, r: Ranks) -> tuple[bytes, list[int]]:
    size = r.first[ids + 1] - r.first[ids]
    return r.data[ragged(r.first[ids], size)].tobytes(), np.r_[0, np.cumsum(size)][bounds].tolist()


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of the ids and of the bytes they decode to."""
    with open(ranks_path, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(content.value)
        for batch in batches:
            for i in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(i, 1000)
                ids, bounds = lists(part.column(1))
                text, at = decoded(ids, bounds, r)
                size = r.digit_first[ids + 1] - r.digit_first[ids]
                told, place = r.digits[ragged(r.digit_first[ids], size)].tobytes(), np.r_[0, np.cumsum(size)][bounds].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(told[a : max(a, b - 1)]).hexdigest() for a, b in zip(place, place[1:])], pa.string()),
                        pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), default_ranks()), default_ranks())
