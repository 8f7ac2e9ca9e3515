"""Benchmark decontamination over a stored positional inverted index, partitioned by document."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Words, flat, hashes, pieces, ragged, table, texts, written

#: Words of a window, and how far a term may lie from its place in a proximity match.
WIDTH, SLOP = 10, 3
#: Bytes of test text that one broadcast holds; a larger benchmark is taken in blocks, each over all rows.
BLOCK_BYTES = 16 << 20

#: A segment of the index: its documents (ids, hashes of the texts, numbers of words), and the postings of all their words. terms and sizes:
#: the distinct words themselves and their bytes, in the order of their hashes; counts: postings of each; places: the
#: positions, term by term, as packed differences.
POSTINGS = "segment string, ids array<long>, keys array<long>, words array<int>, terms binary, sizes binary, counts binary, places binary"
SCHEMA = "doc_id long, text_key long, n_words long, hits array<int>, items array<string>, near_items array<string>, segment string, row int"


def windows(ids: list[str], words: list[str], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list[str]]:
    """Windows of all items: the distinct words, word numbers (one row of `width` each, padded), true lengths, and item id of each."""
    w = Words(*flat(pa.array(words, pa.string())))
    raw, number = w.low.tobytes(), {}
    term = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(w.begin.tolist(), w.end.tolist())], np.int64)
    n = np.diff(w.first)
    per = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    start, item = ragged(w.first[:-1], per), np.repeat(np.arange(len(n)), per)
    padded = np.r_[term, np.zeros(width, np.int64)]
    rows = padded[start[:, None] + np.arange(width)[None, :]] if len(start) else np.zeros((0, width), np.int64)
    return list(number), rows, np.minimum(n, width)[item], [ids[i] for i in item]


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the index of some documents; positions number the words of a segment."""
    for batch in batches:
        data, offsets = flat(batch.column(2))
        for i, j in pieces(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = words.end - words.begin
            other = hashes(words.low, words.begin, size, seed=1)  # words are the same if both hashes are
            place = np.argsort(words.hash, kind="stable").astype(np.int32)
            same = words.hash[place[1:]] == words.hash[place[:-1]]
            if (same & (other[place[1:]] != other[place[:-1]])).any():
                place = np.lexsort((other, words.hash)).astype(np.int32)
                same = words.hash[place[1:]] == words.hash[place[:-1]]
            first = np.flatnonzero(np.r_[True, ~(same & (other[place[1:]] == other[place[:-1]]))]) if len(place) else np.zeros(0, np.int64)
            counts, at = np.diff(np.append(first, len(place))).astype(np.int32), place[first]
            packed = (words.low[ragged(words.begin[at], size[at])], size[at].astype(np.int32), counts, np.diff(place, prepend=np.int32(0)))
            ids = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(k).slice(i, j - i)) for k in (0, 1)]
            sizes = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), pa.array(np.diff(words.first), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *ids, sizes, *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in packed)], names=["segment", "ids", "keys", "words", "terms", "sizes", "counts", "places"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index of whole texts as a table in the shared folder (POSTINGS).

    Segments hold about 4 MB of text each and are made where the texts are read: nothing is shuffled, and a word or
    passage that a third of all documents hold adds to a segment no more than its own postings. The table serves
    any number of searches; no text is read again.
    """
    return written(texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(postings, POSTINGS), "postings")


class Terms:
    """Words, their bytes one after the other, and their hashes."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        self.data, self.size = data, size.astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.hash = hashes(data, self.first, self.size)

    def equal(self, own: np.ndarray, other: Terms, its: np.ndarray) -> np.ndarray:
        """Whether the words of the given numbers have the same bytes."""
        ok = self.size[own] == other.size[its]
        at = np.flatnonzero(ok)
        if len(at):
            n = self.size[own[at]]
            ok[at] = np.logical_and.reduceat(self.data[ragged(self.first[own[at]], n)] == other.data[ragged(other.first[its[at]], n)], np.cumsum(n) - n)
        return ok


class Index:
    """Postings (test term -> positions) of one segment; the words of different documents are kept apart by `doc`."""

    def __init__(self, words: np.ndarray, terms: bytes, sizes: bytes, counts: bytes, places: bytes, wanted: Terms):
        self.words = np.r_[0, np.cumsum(words)].astype(np.int64)
        self.head, self.tail = self.words[:-1], self.words[1:] - 1
        have = Terms(np.frombuffer(zlib.decompress(terms), np.uint8), np.frombuffer(zlib.decompress(sizes), np.int32))
        size = np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
        count, at = np.zeros(len(wanted.hash), np.int64), np.zeros(len(wanted.hash), np.int64)
        place, todo = np.searchsorted(have.hash, wanted.hash), np.arange(len(wanted.hash))
        while len(todo):  # a second round only where another word has the same hash
            todo = todo[place[todo] < len(have.hash)]
            todo = todo[have.hash[place[todo]] == wanted.hash[todo]]
            same = have.equal(place[todo], wanted, todo)
            at[todo[same]], count[todo[same]] = place[todo[same]], size[place[todo[same]]]
            todo = todo[~same]
            place[todo] += 1
        every = np.cumsum(np.frombuffer(zlib.decompress(places), np.int32), dtype=np.int64)
        begin = np.r_[0, np.cumsum(size)][at]
        self.places = every[ragged(begin, count)]
        self.first = np.r_[0, np.cumsum(count)]
        #: One ascending list of all (term, position) postings, for membership tests.
        self.span = np.int64(self.words[-1] + 1)
        self.keys = np.repeat(np.arange(len(count)), count) * self.span + self.places

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words, place, side="right") - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a posting from `low` to `high`."""
        if not len(self.keys):
            return np.zeros(len(term), bool)
        at = np.searchsorted(self.keys, term * self.span + low)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (high >= low) & (found <= term * self.span + high)


def intersect(index: Index, terms: np.ndarray, lens: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start) of exact phrases, and (window, document) of proximity matches.

    terms: term numbers, one row a window. The list of a window's rarest term, moved back by its offset, gives the
    starts; the lists of the next rarest terms are intersected with it, one after the other. A proximity match has
    the three rarest terms within `slop` of their places and in the same document.
    """
    counts = index.counts()
    width = terms.shape[1]
    freq = np.where(np.arange(width)[None, :] < lens[:, None], counts[terms], np.iinfo(np.int64).max)
    live = np.flatnonzero(freq.min(axis=1) > 0)
    order = np.zeros(terms.shape, np.int64)
    order[live] = np.argsort(freq[live], axis=1, kind="stable")
    offset = order[live, 0]
    anchor = terms[live, offset]
    window = np.repeat(live, counts[anchor])
    place = index.places[ragged(index.first[anchor], counts[anchor])]
    start, doc = place - np.repeat(offset, counts[anchor]), index.doc(place)
    near_w, near_s, near_d = window, start, doc
    within = (start >= index.head[doc]) & (start + lens[window] - 1 <= index.tail[doc])
    window, start = window[within], start[within]
    for k in range(1, width):
        at = order[window, k]
        keep = (k >= lens[window]) | index.holds(terms[window, at], start + at, start + at)
        window, start = window[keep], start[keep]
    for k in (1, 2):
        at = order[near_w, k]
        low, high = np.maximum(near_s + at - slop, index.head[near_d]), np.minimum(near_s + at + slop, index.tail[near_d])
        keep = (k >= lens[near_w]) | index.holds(terms[near_w, at], low, high)
        near_w, near_s, near_d = near_w[keep], near_s[keep], near_d[keep]
    return window, start, near_w, near_d


def search(index: DataFrame, items: list[tuple[str, str]], width: int, slop: int) -> tuple[DataFrame, Broadcast]:
    """One block of test items against every segment of the index, and the broadcast that the block travels in."""
    vocabulary, terms, lens, owner = windows([i for i, _ in items], [t for _, t in items], width)
    names = sorted(set(owner))
    place = {x: k for k, x in enumerate(names)}
    number = np.array([place[x] for x in owner], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, terms, lens, names, number))  # of one block, at most a few times block_bytes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, terms, lens, names, number = shared.value
        wanted = Terms(np.frombuffer(b"".join(vocabulary), np.uint8), np.array([len(x) for x in vocabulary], np.int64))
        for batch in batches:
            for k in range(batch.num_rows):
                segment, ids, keys, words, *packed = (c[k] for c in batch.columns)
                n = len(ids.values)
                at = Index(np.asarray(words.values), *(x.as_py() for x in packed), wanted)
                if len(terms):
                    w, s, nw, nd = intersect(at, terms, lens, slop)
                else:
                    w = s = nw = nd = np.zeros(0, np.int64)
                marks = np.zeros(at.words[-1] + 1, np.int64)
                np.add.at(marks, s, 1)
                np.add.at(marks, s + lens[w], -1)
                hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                out = []
                for found, inside in ((w, at.doc(s)), (nw, nd)):
                    pairs = np.unique(inside * len(names) + number[found])
                    bounds = np.searchsorted(pairs, np.arange(n + 1) * max(len(names), 1))
                    out.append(pa.array([[names[x % len(names)] for x in pairs[a:b]] for a, b in zip(bounds, bounds[1:])], pa.list_(pa.string())))
                bounds = np.searchsorted(hit, at.words)
                hits = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hit - np.repeat(at.head, np.diff(bounds)), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids.values, keys.values, pa.array(np.diff(at.words), pa.int64()), hits, *out, pa.array([segment.as_py()] * n, pa.string()), pa.array(np.arange(n), pa.int32())],
                    names=["doc_id", "text_key", "n_words", "hits", "items", "near_items", "segment", "row"],
                )

    return index.mapInArrow(task, SCHEMA), shared


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Where the words of test items occur in the documents: exact phrases of `width` words, and proximity matches.

    The positional inverted index of all words is written to the shared folder, partitioned by document (see
    build_index). Every task takes the postings of the test terms from its segments and intersects them there, moved
    by their offsets, from the rarest term on; a passage that a third of all documents hold costs no task more than
    its own rows. Words are told apart by their bytes. The test items go to the tasks in blocks of at most `block_bytes`;
    each block is searched in all segments, its findings are kept as a table, and they are merged by row.

    Returns doc_id, text_key (xxhash64 of the text, which tells rows of one id apart), n_words, hits (numbers of the words inside an occurrence of a window), items (ids as strings,
    sorted, of the items with an occurring window), near_items. An item of fewer words is one window; one
    without words, or null, has none; items without an id are left out. A null or empty document has no words. Rows
    that repeat an id or have none are searched one by one and give a row each; an empty table gives no rows, an
    empty benchmark no hits; other columns of either table are ignored.
    """
    index = build_index(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    found, block, size = [], [], 0

    def done() -> DataFrame:
        rows, shared = search(index, block, width, slop)
        if last and not found:  # the only block
            return rows
        rows = written(rows, "hits")
        shared.destroy()
        return rows

    last = False
    for r in items.toLocalIterator():  # the stated query set, a block at a time
        if block and size + len(r["text"]) * 2 > block_bytes:
            found.append(done())
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"]) * 2
    last = True
    found.append(done())
    union = found[0]
    for x in found[1:]:
        union = union.unionByName(x)
    if len(found) > 1:  # a row a block
        lists = {c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near_items")}
        union = union.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.max("n_words").alias("n_words"), *lists.values())
    return union.select("doc_id", "text_key", "n_words", "hits", "items", "near_items")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, d.n, item_id FROM dwin d JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
