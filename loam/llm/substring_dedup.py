"""Substring dedup over sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import code_points
from loam.llm.common import ODD, Words, flat, mix, pieces, ragged, table
from loam.llm.shares import ASKED, NO_ID, SHARE_BYTES, answer, ask, numbered, share_count

#: A span has at least so many sentences and words.
SENTENCES, WORDS = 2, 16
#: Of so many words in a row, one at least begins a piece of a long sentence.
WINDOW = 8

STOP = np.zeros(256, bool)
STOP[[*b".!?"]] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Characters outside ASCII that end a sentence, that are white space, and that are words of their own, as their scripts have no blanks.
END, SPACE, ALONE = 1, 2, 3
UNSPACED = "Han Hiragana Katakana Bopomofo Yi Thai Lao Khmer Myanmar Tibetan Tai_Le New_Tai_Lue Tai_Tham Tai_Viet Javanese Balinese".split()
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    if not _kinds:
        import regex

        out = np.zeros(0x110000, np.uint8)
        everything = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
        unspaced = "[" + "".join(rf"\p{{Script={x}}}" for x in UNSPACED) + "\u30fc\uff70]"
        for kind, pattern in ((ALONE, unspaced), (SPACE, r"\s"), (END, "[\\p{Sentence_Terminal}\u2026\u0085\u2028\u2029]")):
            out[[ord(c) for c in regex.findall(pattern, everything)]] = kind
        _kinds.append(out)
    return _kinds[0]


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words, cut at white space and sentence marks outside ASCII and about each character of an unspaced script; places of those marks."""
    at = np.flatnonzero(data >= 128)
    points, place = code_points(data[at])
    size, kind, at = np.diff(np.append(place, len(at))), kinds()[points], at[place]
    out, alone = (kind == END) | (kind == SPACE), kind == ALONE
    return Words(data, offsets, ragged(at[out], size[out]), np.r_[at[alone], at[alone] + size[alone]]), at[kind == END]


def cut_long(words: Words, new: np.ndarray) -> np.ndarray:
    """Which words begin a sentence or a piece of one, given which begin one.

    A sentence of WORDS words or more is cut at the word of least hash (the last of equal ones) of every WINDOW words
    in it but for its first. So no piece is longer than WINDOW, and the cuts depend on the WINDOW - 1 words before and
    after them alone: a repeated passage is cut alike away from its ends.
    """
    n = len(new)
    number = np.cumsum(new) - 1
    long = np.diff(np.append(np.flatnonzero(new), n)) >= WORDS
    start = np.arange(max(n - WINDOW + 1, 0))
    start = start[long[number[start]] & ~new[start] & (number[start] == number[start + WINDOW - 1])]
    best, at = words.hash[start], start.copy()
    for k in range(1, WINDOW):
        h = words.hash[start + k]
        less = h <= best
        best[less], at[less] = h[less], start[less] + k
    out = new.copy()
    out[at] = True
    return out


class Spans:
    """Sentences of several texts and the spans that begin at each.

    A sentence ends at a line end or at a full stop, question or exclamation mark that white space follows. With
    `every`, sentence marks and blanks of other scripts count, and a sentence of WORDS words or more is cut (see
    parted and cut_long): a text of WORDS words or more always has a span.

    The span of a sentence is the shortest run of sentences from it on that has SENTENCES sentences and WORDS words;
    near a text's end there is none. With `every`, the shortest such run up to the end of each sentence is a span
    too: a longer run is the union of spans of both kinds within it, so all runs are looked up. Spans are equal if
    their words are, in lower case.

    first: number of each text's first sentence (n + 1 values); begin: byte at which each sentence begins;
    start, stop: first sentence of a span and the one after its last; key: its hash; doc: its text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, every: bool = False):
        words, more = parted(data, offsets) if every else (Words(data, offsets), [])
        n = len(words.begin)
        mark = (data == 10) | (STOP[data] & np.r_[BLANK[data[1:]], True]) if len(data) else np.zeros(0, bool)
        mark[more] = True
        marks = np.r_[0, np.cumsum(mark)]
        new = np.ones(n, bool)
        new[1:] = (marks[words.begin[1:]] > marks[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1])
        if every:
            new = cut_long(words, new)
        head = np.flatnonzero(new)  # first word of each sentence
        doc = words.doc[head]
        self.first = np.searchsorted(doc, np.arange(len(offsets)))
        self.begin = words.begin[head].copy()
        own = self.first[:-1][np.diff(self.first) > 0]
        self.begin[own] = offsets[:-1][doc[own]]  # what comes before the first word belongs to its sentence
        edges = np.append(head, n)
        count = len(head)
        at = np.arange(count)
        wanted = np.maximum(head + WORDS, edges[np.minimum(at + SENTENCES, count)])
        stop = np.searchsorted(edges, wanted)
        last = self.first[1:][doc] if count else at
        ok = stop <= last
        self.start, self.stop, self.doc = at[ok], stop[ok], doc[ok]
        if every:
            start = np.searchsorted(edges, np.minimum(edges[1:] - WORDS, edges[np.maximum(at + 1 - SENTENCES, 0)]), side="right") - 1
            ok = start >= self.first[:-1][doc]
            ok[ok] = stop[start[ok]] != at[ok] + 1  # the others are spans of their first sentence
            self.start, self.stop, self.doc = np.r_[self.start, start[ok]], np.r_[self.stop, at[ok] + 1], np.r_[self.doc, doc[ok]]
        a, size = edges[self.start], edges[self.stop] - edges[self.start]
        if len(a):
            begin = np.cumsum(size) - size
            number = np.arange(int(size.sum())) - np.repeat(begin, size)
            self.key = mix(np.add.reduceat(mix(words.hash[np.repeat(a, size) + number] ^ mix((number + 1).astype(np.uint64) * np.uint64(ODD))), begin) + size.astype(np.uint64))
        else:
            self.key = np.zeros(0, np.uint64)


def keys_of(data: np.ndarray, offsets: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    spans = Spans(data, offsets, every)
    return spans.key, spans.doc


KEPT = "doc_id long, n_sentences long, removed array<struct<first:int,last:int>>, kept string"
_run = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def cut_out(batches: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[pa.RecordBatch]:
    """Texts less the sentences of their non-first spans; a share's answers arrive at its first row."""
    known: dict[int, dict[int, int]] = {}
    for batch in batches:
        share, ids = np.asarray(batch.column(1)), np.asarray(batch.column(4))
        data, offsets = flat(batch.column(2))
        told = batch.column(3)
        for i, j in pieces(offsets, 2 << 20):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            spans, of = Spans(part, own, every), share[i:j]
            least = ids[i:j][spans.doc]
            for s in np.unique(of).tolist():
                answers = known.setdefault(s, {})
                for r in np.flatnonzero(of == s).tolist():
                    for x in told[i + r].as_py() or ():
                        answers.update(zip(np.frombuffer(x["keys"], np.uint64).tolist(), np.frombuffer(x["least"], np.int64).tolist()))
                mine = np.flatnonzero(of[spans.doc] == s)
                found = list(map(answers.get, spans.key[mine].tolist(), least[mine].tolist()))
                least[mine] = np.array(found, np.int64)
            again = least < ids[i:j][spans.doc]
            order = np.lexsort((spans.start, spans.key, spans.doc))  # within a text, all but the first
            k, d = spans.key[order], spans.doc[order]
            again[order[1:]] |= (k[1:] == k[:-1]) & (d[1:] == d[:-1])
            marks = np.zeros(len(spans.begin) + 1, np.int64)
            np.add.at(marks, spans.start[again], 1)
            np.add.at(marks, spans.stop[again], -1)
            gone = np.cumsum(marks[:-1]) > 0
            size = np.diff(np.append(spans.begin, len(part)))
            byte = np.zeros(len(part), bool)
            if len(size):
                ends = np.minimum(spans.begin + size, own[1:][np.repeat(np.arange(j - i), np.diff(spans.first))])
                at = np.zeros(len(part) + 1, np.int64)
                np.add.at(at, spans.begin[gone], 1)
                np.add.at(at, ends[gone], -1)
                byte = np.cumsum(at[:-1]) > 0
            doc = np.repeat(np.arange(j - i), np.diff(spans.first))
            head = np.flatnonzero(gone & ~(np.r_[False, gone[:-1]] & np.r_[False, doc[1:] == doc[:-1]])) if len(gone) else np.zeros(0, np.int64)
            tail = np.flatnonzero(gone & ~(np.r_[gone[1:], False] & np.r_[doc[1:] == doc[:-1], False])) if len(gone) else head
            base = spans.first[:-1][doc[head]]
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(head, spans.first), pa.int32()), pa.StructArray.from_arrays([pa.array(head - base, pa.int32()), pa.array(tail - base, pa.int32())], fields=list(_run)))
            left = (own - np.r_[0, np.cumsum(byte)][own]).astype(np.int32)
            kept = pa.StringArray.from_buffers(j - i, pa.py_buffer(left.tobytes()), pa.py_buffer(part[~byte].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(4).slice(i, j - i), pa.array(np.diff(spans.first), pa.int64()), runs, kept], names=["doc_id", "n_sentences", "removed", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Texts less every sentence that a non-first repeated span covers (see Spans, for `every` too).

    Every span of the corpus is hashed and looked up over all shares (see shares): a span is non-first if a
    document with a smaller id has it too, or its own text has it before. Sentences are judged on the input.

    Returns doc_id, n_sentences, removed (runs of sentences, first and last number), kept (text that stays). Null
    text is empty; a null id is less than any other; rows of one id never cover one another, and give a row each;
    an empty table gives no rows; other columns of docs are ignored. Texts of fewer than WORDS words stay whole.
    """
    rows = numbered(docs, id_col, text_col)
    n = share_count(rows, share_bytes)
    rows = rows.repartition(n, "row")
    share = F.pmod(F.hash("row"), F.lit(n)).alias("share")
    asked = rows.select("row", share, "text", "doc_id").mapInArrow(lambda b: ask(b, n, partial(keys_of, every=every), least=True), ASKED)
    told = asked.repartition(n, "bucket").mapInArrow(lambda b: answer(b, n, least=True), "number long, keys binary, least binary")
    told = told.withColumnRenamed("number", "row").repartition(n, "row").groupBy("row").agg(F.collect_list(F.struct("keys", "least")).alias("told"))
    whole = rows.join(told.hint("merge"), "row", "left").select("row", share, "text", "told", "doc_id").mapInArrow(partial(cut_out, every=every), KEPT)
    return whole.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), every=True)
    count = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return found.select("doc_id", "n_sentences", count.alias("n_removed"), F.size("removed").cast("long").alias("n_runs"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.length("kept").cast("long").alias("kept_chars"))
