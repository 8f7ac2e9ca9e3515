"""Suffix-array dedup: two-stage suffix sorting over the passages that may repeat, and adjacent common prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import flat, hashes, mix, pieces, powers, prefix_hash, ragged, table
from loam.llm.shares import ASKED, NO_ID, SHARE_BYTES, answer, ascending, ask, numbered, restored, share_count, short

#: Bytes of a repeated string, and of the anchor whose least hash names a window of that many bytes.
WIDTH, ANCHOR = 50, 24
#: Windows of one fragment, at most: a longer stretch with one anchor (a run of one character) is cut.
MOST_WINDOWS = 64
#: Bytes of text whose suffixes are sorted at once; all fragments of one key are always sorted together.
SORT_BYTES = 3 << 20
#: Fragments of one anchor in the whole corpus, at most: those of an anchor that has more are cut into single windows, dealt by all their bytes.
MOST_FRAGMENTS = 1 << 16
#: Bytes of a name that are asked for, beside the bucket, which holds the rest of its division.
NAME_BYTES = 5


NONE = np.zeros(0, np.uint64)


class Runs:
    """Runs of neighbouring windows of one text that share an anchor: first window (byte place), windows, key, text number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, anchor: int):
        lens = np.diff(offsets)
        per = np.maximum(lens - width + 1, 0)
        window = ragged(offsets[:-1], per)
        if not len(window):
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        total, down = prefix_hash(data), powers(len(data))[1]
        least = mix((total[anchor:] - total[:-anchor]) * down[: len(data) - anchor + 1])
        span, reach = width - anchor + 1, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        key = least[window]
        doc = np.repeat(np.arange(len(lens)), per)
        new = np.ones(len(window), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        at = np.arange(len(window))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % MOST_WINDOWS == 0
        first = np.flatnonzero(new)
        self.start, self.key, self.doc = window[first], key[first], doc[first]
        self.count = np.diff(np.append(first, len(window)))


def names(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each fragment."""
    return hashes(data, start, size)


def dealt(data: np.ndarray, runs: Runs, own: np.ndarray, hot: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of the given runs: start, windows, text number, key.

    A run is a fragment. Where its anchor is one of the `hot` ones (as answers name them), each of its windows is,
    and the key is a hash of the window: equal windows still have equal keys, and no key has other windows.
    """
    start, count, doc, key = runs.start[own], runs.count[own], runs.doc[own], runs.key[own]
    if not len(hot):
        return start, count, doc, key
    cut = np.isin(short(key, buckets, NAME_BYTES), hot)
    window = ragged(start[cut], count[cut])
    one = np.ones(len(window), np.int64)
    return (
        np.r_[start[~cut], window], np.r_[count[~cut], one], np.r_[doc[~cut], np.repeat(doc[cut], count[cut])],
        np.r_[key[~cut], hashes(data, window, one * width, seed=1)],
    )


FRAGMENTS = "bucket int, number long, keys binary, docs binary, counts binary, many binary, sizes binary, bytes binary, hot binary"


def fragments(batches: Iterator[pa.RecordBatch], buckets: int, width: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Distinct fragments of each share whose key several rows have, with their least document and whether they have several.

    They leave in packed blocks, one for each share and bucket of keys, and the hot anchors of a share in one more,
    which returns to it. Rows of a share arrive in the order of doc_id, and the first brings all answers to what the
    share asked.
    """
    known: dict[int, set[int]] = {}
    hot: dict[int, np.ndarray] = {}
    held: dict[int, dict[int, list]] = {}
    lowest: dict[int, int] = {}
    for batch in batches:
        numbers, share, ids = (np.asarray(batch.column(c)) for c in (0, 1, 4))
        data, offsets = flat(batch.column(2))
        told = batch.column(3)
        for i, j in pieces(offsets, 2 << 20):
            part = data[offsets[i] : offsets[j]]
            runs = Runs(part, offsets[i : j + 1] - offsets[i], width, anchor)
            of = share[i:j]
            for s in np.unique(of).tolist():
                seen, mine = known.setdefault(s, set()), held.setdefault(s, {})
                lowest.setdefault(s, int(numbers[i:j][of == s].min()))
                for r in np.flatnonzero(of == s).tolist():
                    for x in told[i + r].as_py() or ():
                        seen.update(np.frombuffer(x["keys"], np.uint64).tolist())
                        hot[s] = np.r_[hot.get(s, NONE), np.frombuffer(x["hot"], np.uint64)]
                own = np.flatnonzero(of[runs.doc] == s)
                # keys come back without their uppermost bits; what that lets through falls to the suffix sort
                own = own[np.fromiter(map(seen.__contains__, short(runs.key[own], buckets, NAME_BYTES).tolist()), bool, len(own))]
                if not len(own):
                    continue
                start, count, text, key = dealt(part, runs, own, hot.get(s, NONE), buckets, width)
                size, doc = count + width - 1, ids[i:j][text]
                name = names(part, start, size)
                order = np.lexsort((doc, name))
                first = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
                last = np.append(first[1:], len(order)) - 1
                many = doc[order[first]] != doc[order[last]]
                at = order[first]
                for n, d, m, a, z, k in zip(name[at].tolist(), doc[at].tolist(), many.tolist(), start[at].tolist(), size[at].tolist(), key[at].tolist()):
                    have = mine.get(n)
                    if have is None:
                        mine[n] = [k, d, m, part[a : a + z].tobytes()]
                    else:
                        have[1], have[2] = min(have[1], d), have[2] or m or have[1] != d
    known.clear()
    for s, own in hot.items():
        if len(own):
            values = (lowest[s] % buckets, lowest[s], *[b""] * 6, own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int32(), pa.int64(), *[pa.binary()] * 7))], names=[x.split()[0] for x in FRAGMENTS.split(", ")])
    for s, mine in held.items():
        found = list(mine.values())
        mine.clear()
        if not found:
            continue
        key, doc = np.array([v[0] for v in found], np.uint64), np.array([v[1] for v in found], np.int64)
        many = np.array([v[2] for v in found], bool)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[b] : cut[b + 1]]
            own = [found[k][3] for k in at.tolist()]
            new = np.flatnonzero(np.r_[True, doc[at][1:] != doc[at][:-1]])
            values = (
                b, lowest[s], (key[at] // np.uint64(buckets)).astype(np.uint32).tobytes(), ascending(doc[at][new]), zlib.compress(np.diff(np.append(new, len(at))).astype(np.int32).tobytes(), 1),
                np.packbits(many[at]).tobytes(), zlib.compress(np.array([len(x) for x in own], np.uint16).tobytes(), 1), zlib.compress(b"".join(own), 1), b"",
            )
            yield pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int32()), pa.array([values[1]], pa.int64()), *(pa.array([x], pa.binary()) for x in values[2:])], names=[x.split()[0] for x in FRAGMENTS.split(", ")])


def suffix_order(text: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """The wanted places in the order of the `width` bytes that begin there, by two-stage suffix sorting.

    text ends in at least `width` zero bytes that no wanted place's window needs. A suffix is of type B if it is
    smaller than its successor, else of type A. Suffixes of type B are sorted directly. Then the buckets of first
    bytes are scanned upwards: within a bucket, A comes before B, and scanning a suffix puts its predecessor, if
    that is of type A, at the end of what its bucket holds so far. Beside the wanted places the set holds, after
    each run of them, the places up to the next suffix of type B, so that every A in it is induced.
    """
    n = len(text) - width
    step = text[1 : n + 1].astype(np.int16) - text[:n]
    at = np.arange(n)
    # of a run of equal bytes, the first byte after it decides
    decisive = np.minimum.accumulate(np.where(step != 0, at, n)[::-1])[::-1]
    is_b = np.append(np.append(step, 1)[decisive] > 0, True)
    next_b = np.minimum.accumulate(np.where(is_b, np.arange(n + 1), n)[::-1])[::-1]
    taken = np.zeros(n + 1, bool)
    taken[wanted] = True
    ends = wanted[np.append(wanted[1:] != wanted[:-1] + 1, True)]
    taken[ragged(ends, next_b[ends] - ends + 1)] = True
    direct = np.flatnonzero(taken & is_b)
    view = np.lib.stride_tricks.sliding_window_view(text, width)
    keys = np.ascontiguousarray(view[direct]).view(f"S{width}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    first = text[direct]
    cut = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    is_a = taken & ~is_b
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        whole = []
        while len(wave):  # within the bucket, longer runs of its byte come later
            whole.append(wave)
            before = wave[wave > 0] - 1
            wave = before[is_a[before] & (text[before] == c)]
        whole.append(direct[cut[c] : cut[c + 1]])
        bucket = np.concatenate(whole)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[is_a[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            bounds = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            for b, group in zip(byte[bounds].tolist(), np.split(before, bounds[1:])):
                induced[b].append(group)
    whole = np.concatenate(out) if out else np.zeros(0, np.int64)
    keep = np.zeros(n + 1, bool)
    keep[wanted] = True
    return whole[keep[whole]]


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Common prefix of each suffix and the one before it, up to `width`; 0 for the first."""
    view = np.lib.stride_tricks.sliding_window_view(text, width)
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 1 << 17):
        j = min(len(order), i + (1 << 17))
        same = view[order[i:j]] == view[order[i - 1 : j - 1]]
        out[i:j] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return out


#: A part: first and last window of a fragment, and the least document that has them.
PART = np.dtype([("first", np.int32), ("last", np.int32), ("doc", np.int64)])


def least_documents(key: np.ndarray, ids: np.ndarray, many: np.ndarray, asker: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """For each asking share and fragment, the least document that has each of its windows, in parts of equal answers.

    A fragment of one document whose windows no lesser document has can't change anything and gets no answer.
    """
    name = names(data, offsets[:-1], np.diff(offsets))
    asking = np.lexsort((ids, name, key))
    k, n = key[asking], name[asking]
    head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
    askers = np.diff(np.append(head, len(asking)))
    order = asking[head]
    size = np.diff(offsets)[order]
    text = np.concatenate((data[ragged(offsets[order], size)], np.zeros(width, np.uint8)))
    at = np.r_[0, np.cumsum(size)]
    per = size - width + 1
    wanted = ragged(at[:-1], per)
    owner = np.repeat(np.arange(len(order)), per)
    suffixes = suffix_order(text, wanted, width)
    prefix = common_prefixes(text, suffixes, width)
    place = np.zeros(len(text), np.int64)
    place[wanted] = np.arange(len(wanted))
    window = place[suffixes]
    group = np.flatnonzero(prefix < width)
    least = np.minimum.reduceat(ids[order][owner[window]], group)
    answer = np.empty(len(wanted), np.int64)
    answer[window] = np.repeat(least, np.diff(np.append(group, len(window))))
    new = np.flatnonzero(np.r_[True, (answer[1:] != answer[:-1]) | (owner[1:] != owner[:-1])])
    begin = np.r_[0, np.cumsum(per)][:-1][owner[new]]
    parts = np.empty(len(new), PART)
    parts["first"], parts["last"], parts["doc"] = new - begin, np.append(new[1:], len(wanted)) - 1 - begin, answer[new]
    cut = np.searchsorted(owner[new], np.arange(len(order) + 1))
    lesser = np.logical_or.reduceat(answer < ids[order][owner], np.r_[0, np.cumsum(per)][:-1])
    several = (askers > 1) | np.logical_or.reduceat(many[asking], head)
    useful = np.repeat(lesser | several, askers)
    fragment = np.repeat(np.arange(len(order)), askers)[useful]
    asking = asking[useful]
    by_share = np.argsort(asker[asking], kind="stable")
    asking, fragment = asking[by_share], fragment[by_share]
    to = asker[asking]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), np.append(first[1:], len(to)).tolist()):
        own = fragment[a:b]
        count = np.diff(cut)[own]
        blob = parts[ragged(cut[own], count)]
        yield pa.RecordBatch.from_arrays([pa.array(to[a : a + 1], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (name[asking[a:b]], count.astype(np.int32), blob)), pa.array([b""], pa.binary())], names=["number", "names", "counts", "parts", "hot"])


def sort_fragments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Unpacks the blocks of a task's buckets and sorts them some MB at a time, never between two fragments of one key."""
    parts = []
    for batch in batches:
        for bucket, number, keys, docs, counts, many, sizes, packed, hot in zip(*(c.to_pylist() for c in batch.columns)):
            if hot:
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (b"", b"", b"", hot))], names=["number", "names", "counts", "parts", "hot"])
                continue
            key = np.frombuffer(keys, np.uint32).astype(np.uint64) | np.uint64(bucket) << np.uint64(32)
            doc = np.repeat(restored(docs), np.frombuffer(zlib.decompress(counts), np.int32))
            parts.append((key, doc, np.unpackbits(np.frombuffer(many, np.uint8))[: len(key)].astype(bool), np.full(len(key), number, np.int64), np.frombuffer(zlib.decompress(sizes), np.uint16).astype(np.int64), np.frombuffer(zlib.decompress(packed), np.uint8)))
    if not parts:
        return
    key, doc, many, asker, size, data = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    start = np.r_[0, np.cumsum(size)][:-1]
    order = np.argsort(key, kind="stable")
    ends = np.flatnonzero(np.r_[key[order][1:] != key[order][:-1], True]) + 1  # cuts between keys
    total = np.cumsum(size[order])[ends - 1]
    i, done = 0, 0
    while i < len(order):
        c = min(int(np.searchsorted(total, done + SORT_BYTES)), len(ends) - 1)
        j = int(ends[c])
        at = order[i:j]
        yield from least_documents(key[at], doc[at], many[at], asker[at], data[ragged(start[at], size[at])], np.r_[0, np.cumsum(size[at])], width)
        i, done = j, int(total[c])


KEPT = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
_span = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def cut_out(batches: Iterator[pa.RecordBatch], buckets: int, width: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Texts less the windows of their fragments that a lesser document has; answers arrive as in fragments()."""
    known: dict[int, dict[int, bytes]] = {}
    hot: dict[int, np.ndarray] = {}
    for batch in batches:
        share, ids = np.asarray(batch.column(1)), np.asarray(batch.column(4))
        data, offsets = flat(batch.column(2))
        told = batch.column(3)
        for i, j in pieces(offsets, 2 << 20):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            runs = Runs(part, own, width, anchor)
            of = share[i:j]
            marks = np.zeros(len(part) + 1, np.int64)
            for s in np.unique(of).tolist():
                answers = known.setdefault(s, {})
                for r in np.flatnonzero(of == s).tolist():
                    for x in told[i + r].as_py() or ():
                        ends = (np.cumsum(np.frombuffer(x["counts"], np.int32), dtype=np.int64) * PART.itemsize).tolist()
                        answers.update(zip(np.frombuffer(x["names"], np.int64).tolist(), (x["parts"][a:b] for a, b in zip([0, *ends], ends))))
                        hot[s] = np.r_[hot.get(s, NONE), np.frombuffer(x["hot"], np.uint64)]
                start, count, text, _ = dealt(part, runs, np.flatnonzero(of[runs.doc] == s), hot.get(s, NONE), buckets, width)
                found = list(map(answers.get, names(part, start, count + width - 1).view(np.int64).tolist()))
                blobs = [x or b"" for x in found]
                parts = np.frombuffer(b"".join(blobs), PART)
                of_part = np.repeat(np.arange(len(start)), np.array([len(x) // PART.itemsize for x in blobs], np.int64))
                lesser = parts["doc"] < ids[i:j][text[of_part]]
                of_part, parts = of_part[lesser], parts[lesser]
                np.add.at(marks, start[of_part] + parts["first"], 1)
                np.add.at(marks, start[of_part] + parts["last"] + width, -1)
            gone = np.cumsum(marks[:-1]) > 0
            edge = np.zeros(len(part) + 1, bool)
            edge[own] = True
            starts = np.flatnonzero(gone & (~np.r_[False, gone[:-1]] | edge[:-1])) if len(part) else np.zeros(0, np.int64)
            ends = np.flatnonzero(gone & (~np.r_[gone[1:], False] | edge[1:])) + 1 if len(part) else starts
            cut = np.searchsorted(starts, own)
            base = np.repeat(own[:-1], np.diff(cut))
            spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - base, pa.int32()), pa.array(ends - base, pa.int32())], fields=list(_span)))
            at = (own - np.r_[0, np.cumsum(gone)][own]).astype(np.int32)
            kept = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(part[~gone].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(4).slice(i, j - i), pa.array(np.diff(own), pa.int64()), spans, kept], names=["doc_id", "n_bytes", "spans", "kept"])


def suffix_dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_FRAGMENTS, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """What stays of each text once bytes covered by a `width`-byte string of a lesser document are removed.

    1. Each window of `width` bytes is named by the least hash of the anchors in it, so equal windows have equal
       names; neighbouring windows of one name are a run. Shares of the documents ask, once a name, whether rows
       elsewhere have it too (names travel as packed blocks; a name in a third of all rows is asked once a share).
       Of an anchor with more than `most` runs in all, in however many surroundings, each window becomes a fragment
       of its own, named by all its bytes, so that no name gathers more than `most` different strings.
    2. The bytes of runs with shared names, distinct within a task, are dealt by name. There their suffixes are
       sorted in two stages, and adjacent common prefixes of `width` give the least document of every window.
    3. Every share gets the answers to its own fragments, and cuts windows that a lesser document has out of its
       texts. A fragment in a third of all rows is asked and answered once a share.

    Every fragment that repeats reaches the suffix sort; names only decide what can't repeat, and no row, name or
    group is capped. Returns doc_id, n_bytes, spans (maximal removed runs, bytes), kept (bytes). Matches never cross
    documents. Null text is empty; a null id is less than any other; rows of one id never cover one another;
    repeated rows give a row each; an empty table gives no rows; other columns of docs are ignored.
    """
    rows = numbered(docs, id_col, text_col)
    n = share_count(rows, share_bytes)
    rows = rows.repartition(n, "row")
    share = F.pmod(F.hash("row"), F.lit(n)).alias("share")

    def keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = Runs(data, offsets, width, anchor)
        return runs.key, runs.doc

    def returned(answers: DataFrame, *columns: str) -> DataFrame:
        """Each share's answers at its first row."""
        told = answers.withColumnRenamed("number", "row").repartition(n, "row").groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("told"))
        return rows.join(told.hint("merge"), "row", "left").select("row", share, "text", "told", "doc_id")

    asked = rows.select("row", share, "text", "doc_id").mapInArrow(lambda b: ask(b, n, keys_of, NAME_BYTES, counted=True), ASKED)
    told = asked.repartition(n, "bucket").mapInArrow(lambda b: answer(b, n, NAME_BYTES, most=most), "number long, keys binary, hot binary")
    parts = returned(told, "keys", "hot").mapInArrow(lambda b: fragments(b, n, width, anchor), FRAGMENTS)
    answers = parts.repartition(n, "bucket").mapInArrow(lambda b: sort_fragments(b, width), "number long, names binary, counts binary, parts binary, hot binary")
    whole = returned(answers, "names", "counts", "parts", "hot").mapInArrow(lambda b: cut_out(b, n, width, anchor), KEPT)
    return whole.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
