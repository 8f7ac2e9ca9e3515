"""Language ID by bit-sliced Bloom filters: one lookup of an n-gram gives all languages that have it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import LETTER, classes, code_points
from loam.llm.common import flat, mix, pieces, table

#: Characters of an n-gram; a gap between letters counts as one blank, and a text begins and ends with two.
GRAM = 4
#: Labelled rows of each language that the filters are learnt from, at most in expectation: rows are drawn by a hash of id and text.
SAMPLE_ROWS = 20_000
#: Slots of the filter and probes of an n-gram: 2 ** 21 slots of 8 bytes (16 MB) for each 63 languages.
SLOTS, PROBES = 1 << 21, 4
#: A language has an n-gram that it saw this often, and this often relative to the language that has it most.
LEAST_COUNT, LEAST_SHARE = 2, 0.1
MASK_BITS = 63

_lower: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    if not _lower:
        out = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(classes() == LETTER).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                out[c] = ord(low)
        _lower.append(out)
    return _lower[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, text number of each, whether each text has a letter)."""
    n = len(offsets) - 1
    points, place = code_points(data) if len(data) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    doc = np.searchsorted(offsets, place, side="right") - 1
    letter = classes()[points] == LETTER
    has = np.zeros(n, bool)
    has[doc[letter]] = True
    same = np.r_[False, doc[1:] == doc[:-1]] if len(doc) else np.zeros(0, bool)
    before = np.r_[False, letter[:-1]] & same
    keep = letter | before  # the first of each gap after a letter stands for the gap
    value = np.where(letter, lower_table()[points], np.uint32(32))[keep]
    doc = doc[keep]
    count = np.bincount(doc, minlength=n)
    # two blanks before and after each text that has letters
    pad = np.where(has, 4, 0)
    start = np.r_[0, np.cumsum(count + pad)]
    seq = np.full(start[-1], 32, np.uint64)
    seq[np.arange(len(value)) + np.repeat(start[:-1] - np.r_[0, np.cumsum(count)][:-1] + 2, count)] = value
    owner = np.repeat(np.arange(n), count + pad)
    if len(seq) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    h = np.zeros(len(seq) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x110001) + seq[k : len(seq) - GRAM + 1 + k]
    ok = (owner[GRAM - 1 :] == owner[: len(seq) - GRAM + 1]) & (h != h32)
    return mix(h[ok]), owner[: len(ok)][ok], has


h32 = np.uint64(0)
for _ in range(GRAM):
    h32 = np.uint64((int(h32) * 0x110001 + 32) % (1 << 64))


def probes(gram: np.ndarray) -> np.ndarray:
    """Slots of each n-gram, one row a probe."""
    out, h = [], gram
    for _ in range(PROBES):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
        out.append((h >> np.uint64(40)) % np.uint64(SLOTS))
    return np.array(out).astype(np.int64)


@dataclass
class Filters:
    languages: list[str]
    #: One row for each MASK_BITS languages.
    masks: np.ndarray

    def __post_init__(self):
        self.false = np.array([(np.count_nonzero(self.masks[k // MASK_BITS] >> np.int64(k % MASK_BITS) & 1) / SLOTS) ** PROBES for k in range(len(self.languages))])


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (language number, text) -> counts of the task by language and n-gram."""
    for batch in batches:
        language = np.asarray(batch.column(0))
        data, offsets = flat(batch.column(1))
        for i, j in pieces(offsets, 2 << 20):
            gram, doc, _ = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own = language[i:j][doc]
            for k in np.unique(own).tolist():
                value, n = np.unique(gram[own == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["language", "gram", "n"])


def sample(known: DataFrame, counts: dict[str, int], rows: int) -> DataFrame:
    """Rows of known (doc_id, text, lang) with `number`, the place of their language by name: all of a language that has `rows` or fewer, else that many in expectation."""
    languages = sorted(counts)
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    below = F.array(*(F.lit(int(min(1.0, rows / counts[x]) * (1 << 30))) for x in languages))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("language")), F.lit(1 << 30)) < F.element_at(below, F.col("number") + 1)
    return known.withColumn("number", number).where(drawn)


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Filters:
    """Filters from a bounded sample of each language's labelled rows (text and lang not null), drawn by a hash of id and text, so null or repeated ids are drawn like others.

    A language of at most `rows` rows is learnt whole however large the others are; `rows` for each language bound all.
    An n-gram belongs to every language that has it LEAST_COUNT times and at LEAST_SHARE of the best language's
    rate or more. Of the sums, one mask for each used slot of the filter comes to the driver, 2 ** 21 at most.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).agg(F.count("*")).collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return Filters([], np.zeros((1, SLOTS), np.int64))
    known = known.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    seen = sample(known, counts, rows).select(F.col("number").alias("language"), "text").mapInArrow(gram_counts, "language int, gram long, n long")
    seen = seen.groupBy("gram", "language").agg(F.sum("n").alias("n"))
    totals = {r[0]: r[1] for r in seen.groupBy("language").agg(F.sum("n")).collect()}
    share = F.col("n") / F.element_at(F.array(*(F.lit(float(totals.get(k, 1))) for k in range(len(languages)))), F.col("language") + 1)
    best = seen.where(F.col("n") >= LEAST_COUNT).withColumn("share", share).groupBy("gram").agg(F.collect_list(F.struct("language", "share")).alias("all"), F.max("share").alias("most"))
    kept = F.filter("all", lambda x: x["share"] >= LEAST_SHARE * F.col("most"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = probes(np.asarray(batch.column(0)).view(np.uint64))
            lists = batch.column(1)
            bounds = np.asarray(lists.offsets)
            member = np.asarray(lists.values)[bounds[0] : bounds[-1]]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            slot, word, bit = at[:, owner].ravel(), np.tile(member // MASK_BITS, PROBES), np.tile(np.int64(1) << (member % MASK_BITS).astype(np.int64), PROBES)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word.astype(np.int32)), pa.array(bit)], names=["slot", "word", "mask"])

    found = best.select("gram", F.transform(kept, lambda x: x["language"]).alias("languages")).mapInArrow(slots, "slot long, word int, mask long")
    rows_ = found.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(((len(languages) - 1) // MASK_BITS + 1, SLOTS), np.int64)
    masks[np.asarray(rows_.column("word")), np.asarray(rows_.column("slot"))] = np.asarray(rows_.column("mask"))
    return Filters(languages, masks)


IDENTIFIED = "doc_id long, lang_pred string, score double, margin double"


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: (doc_id, lang_pred, score, margin), then the columns of `carry` as they are, named carried_0 and so on.

    For each language, the share of the text's n-grams that its filter holds is corrected for the filter's false
    positives; the largest decides (ties: the first by name). score is that share, from 0 to 1, margin its lead
    over the next. A text that is null or has no letter is `und` with score 0, as is every text if nothing was
    learnt. Rows that repeat are judged each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 16 MB for each 63 languages

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        size = len(f.languages)
        names = np.array([*f.languages, "und"], object)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets, 1 << 20):
                gram, doc, has = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total = np.maximum(np.bincount(doc, minlength=j - i), 1)
                share = np.zeros((j - i, max(size, 1)))
                if size and len(gram):
                    distinct, which = np.unique(gram, return_inverse=True)
                    at = probes(distinct)
                    for word in range(len(f.masks)):
                        mask = np.bitwise_and.reduce(f.masks[word][at], axis=0)[which]
                        for k in range(word * MASK_BITS, min(size, (word + 1) * MASK_BITS)):
                            share[:, k] = np.bincount(doc, weights=mask >> np.int64(k % MASK_BITS) & 1, minlength=j - i) / total
                    share = np.clip((share - f.false) / (1 - f.false), 0, 1)
                best = share.argmax(axis=1)
                top = share[np.arange(j - i), best]
                rest = share.copy()
                rest[np.arange(j - i), best] = 0
                told = has & (size > 0)
                best = np.where(told, best, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(told, top, 0.0)), pa.array(np.where(told, top - rest.max(axis=1), 0.0)), *(c.slice(i, j - i) for c in batch.columns[2:])], names=names_out)

    kinds = "".join(f", carried_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    names_out = ["doc_id", "lang_pred", "score", "margin", *(f"carried_{k}" for k in range(len(carry)))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    return rows.mapInArrow(task, IDENTIFIED + kinds)


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learnt from: crc32 of the id as text is divisible by five (null ids among them)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin")
