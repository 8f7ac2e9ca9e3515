"""N-gram Jaccard self-join: MinHash bands give candidates, a posterior bound prunes them, exact sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Words, discard, flat, mix, partitions, pieces, shingles, table, texts, written
from loam.operators.components import components

#: Words of a shingle and least similarity.
WIDTH, THRESHOLD = 5, 0.8
#: Bands of rows: a pair at the threshold shares no band with probability (1 - 0.8 ** 5) ** 42 < 6e-8.
BANDS, ROWS = 42, 5
#: MinHash values that are compared between two looks at the posterior, and the probability below which a pair goes.
STEP, TOLERANCE = 14, 1e-9
#: Sets that one side of a block holds; a larger bucket becomes pairs of blocks.
BLOCK = 256
#: Pairs that a task compares at a time.
AT_ONCE = 1 << 16
#: Stands for a null id beside the text's key, where rows are looked up; it is never returned.
NO_ID = -(1 << 63)

_n = BANDS * ROWS
_seeds = mix(np.arange(1, 2 * _n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
XORS, ODDS = _seeds[:_n], _seeds[_n:] | np.uint64(1)


def minhashes(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (one row a set, uint32) of sets of 64-bit hashes; sets are not empty."""
    out = np.empty((len(offsets) - 1, _n), np.uint32)
    for k in range(_n):
        out[:, k] = np.minimum.reduceat((sets ^ XORS[k]) * ODDS[k], offsets[:-1]) >> np.uint64(32)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """Key of each band of rows of MinHash values, one column a band."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    wide = values.astype(np.uint64).reshape(len(values), BANDS, ROWS)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
    return keys


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number k of compared values, the fewest matches that leave a pair in play.

    With an even prior on the similarity S and m matches of k, P(S >= t) = P(Binomial(k + 1, t) <= m).
    """
    out = {}
    for k in range(STEP, _n + 1, STEP):
        total, m = 0.0, 0
        while m <= k and (total := total + math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)) < tolerance:
            m += 1
        out[k] = m
    return out


SKETCH = "row long, doc_id long, text_key long, n int, one long, two long, bands array<long>"


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and two hashes of each text's shingle set, and its band keys; a set without shingles has none."""
    for batch in batches:
        data, offsets = flat(batch.column(3))
        for i, j in pieces(offsets, 2 << 20):
            sets, bounds = shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), WIDTH)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            one, two = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            keys = np.zeros((0, BANDS), np.uint64)
            if len(some):
                starts = bounds[some]
                one[some] = np.add.reduceat(mix(sets ^ np.uint64(0x51ED270B)), starts)
                two[some] = np.add.reduceat(mix(sets ^ np.uint64(0x2545F4914F6CDD1D)), starts)
                keys = band_keys(minhashes(sets, np.append(starts, bounds[-1])))
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))], pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(n, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), bands], names=["row", "doc_id", "text_key", "n", "one", "two", "bands"])


PLACED = "rep long, copies long, units array<struct<band:int,key:long,blocks:int>>, own long, values binary, set binary"


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHash values and shingle sets (packed, ascending) in place of the texts of the last column."""
    for batch in batches:
        data, offsets = flat(batch.column(4))
        for i, j in pieces(offsets, 2 << 20):
            sets, bounds = shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), WIDTH)
            values = minhashes(sets, bounds)
            packed = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((bounds * 8).astype(np.int32).tobytes()), pa.py_buffer(sets.tobytes())])
            rows = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((np.arange(j - i + 1) * 4 * _n).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(4)), rows, packed], names=["rep", "copies", "units", "own", "values", "set"])


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of sets, those of exact similarity `threshold` or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(left) <= 500:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())], np.int64)
    else:
        # counts of common members of all pairs, as products of 0/1 rows over some thousand members at a time
        rows, other = np.unique(left), np.unique(right)
        both = np.union1d(rows, other)
        member = np.concatenate([sets[k] for k in both.tolist()])
        owner = np.repeat(np.arange(len(both)), sizes[both])
        values, which, count = np.unique(member, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        column = np.full(len(values), -1, np.int64)
        column[shared] = np.arange(len(shared))
        at = column[which]
        owner, at = owner[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        total = np.zeros((len(rows), len(other)), np.float32)
        row_place, other_place = np.searchsorted(both, rows), np.searchsorted(both, other)
        for c in range(0, len(shared), 4096):
            a, b = np.searchsorted(at, (c, c + 4096))
            part = np.zeros((len(both), min(4096, len(shared) - c)), np.float32)
            part[owner[a:b], at[a:b] - c] = 1
            total += part[row_place] @ part[other_place].T
        common = total[np.searchsorted(rows, left), np.searchsorted(other, right)].astype(np.int64)
    ok = common >= threshold * (sizes[left] + sizes[right] - common) - 1e-9
    return left[ok], right[ok]


LINKS = "rep long, links long, root long"
#: Columns of a unit's rows: bucket, pair of blocks, band, this row's block, set and copies, mask of its own buckets' bands, values, set.
WORK = ("key", "i", "j", "band", "block", "rep", "copies", "own", "values", "set")


def join_units(units: list[list[tuple]], threshold: float, fewest: dict[int, int]) -> pa.RecordBatch:
    """Links of the sets of several units: documents linked to each set, and the least set reached.

    A unit is one block of a bucket, or two. Its pairs are those whose lowest shared bucket it is, so that a pair
    that shares many buckets counts once.
    """
    rows = [r for u in units for r in u]
    block, rep, copies, own = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6, 7))
    values = np.frombuffer(b"".join(r[8] for r in rows), np.uint32).reshape(len(rows), _n)
    sets = [np.frombuffer(r[9], np.uint64) for r in rows]
    keys = band_keys(values)
    lefts, rights, bands, of, at = [], [], [], [], 0
    for k, u in enumerate(units):
        first = u[0]
        if first[1] == first[2]:
            a, b = np.triu_indices(len(u), 1)
        else:
            here = block[at : at + len(u)]
            x, y = np.flatnonzero(here == first[1]), np.flatnonzero(here == first[2])
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
        lefts.append(a + at)
        rights.append(b + at)
        bands.append(np.full(len(a), first[3], np.int64))
        of.append(np.full(len(a), k, np.int64))
        at += len(u)
    left, right, band, of = (np.concatenate(x) for x in (lefts, rights, bands, of))
    for b in range(BANDS - 1):  # pairs that share a lower bucket belong to it
        own_b = own >> b & 1 > 0
        keep = (band <= b) | ~own_b[left] | (keys[left, b] != keys[right, b])
        left, right, band, of = left[keep], right[keep], band[keep], of[keep]
    matches = np.zeros(len(left), np.int32)
    for k in range(STEP, _n + 1, STEP):
        matches += np.count_nonzero(values[left, k - STEP : k] == values[right, k - STEP : k], axis=1).astype(np.int32)
        ok = matches >= fewest[k]
        left, right, matches, of = left[ok], right[ok], matches[ok], of[ok]
        if not len(left):
            break
    cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
    found = [verified(sets, left[a:b], right[a:b], threshold) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    left, right = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    names, place = np.unique(rep, return_inverse=True)
    count, root = np.zeros(len(names), np.int64), np.arange(len(names))
    np.add.at(count, place[left], copies[right])
    np.add.at(count, place[right], copies[left])
    while True:  # the units of a call are few: labels spread along their links until they rest
        new = root.copy()
        np.minimum.at(new, place[left], root[place[right]])
        np.minimum.at(new, place[right], root[place[left]])
        if np.array_equal(new, root):
            break
        root = new
    some = count > 0
    return pa.RecordBatch.from_arrays([pa.array(names[some], pa.int64()), pa.array(count[some], pa.int64()), pa.array(names[root[some]], pa.int64())], names=["rep", "links", "root"])


def join_blocks(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Rows (WORK) arrive by bucket and pair of blocks; some units at a time are joined."""
    fewest = least_matches(threshold, tolerance)
    units: list[list[tuple]] = []
    held: list[tuple] = []
    pairs = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:3] != row[:3]:
                if len(held) > 1:
                    units.append(held)
                    pairs += len(held) ** 2 // 2
                held = []
                if pairs >= AT_ONCE:
                    yield join_units(units, threshold, fewest)
                    units, pairs = [], 0
            held.append(row)
    if len(held) > 1:
        units.append(held)
    if units:
        yield join_units(units, threshold, fewest)


def buckets(sets: DataFrame) -> DataFrame:
    """(rep, band, key, size) of the sets that share a band key with others. Of buckets of the same sets, the one of the lowest band stays."""
    banded = sets.select("rep", F.posexplode("bands").alias("band", "key"))
    sized = banded.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min("band").alias("band")).where("size > 1")
    kept = sized.groupBy("size", "x", "y").agg(F.min_by("key", "band").alias("key"))
    return banded.join(kept.select("key", "size").hint("merge"), "key")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links between documents whose sets of five-word shingles have Jaccard similarity `threshold` or more.

    1. Documents of equal shingle sets form one class, kept as one set with a number of copies.
    2. Sets that share a band of MinHash values share a bucket, and only sets of one bucket are ever compared. Buckets
       of the same sets collapse to one.
    3. A bucket of more than `block` sets is cut in blocks; each pair of blocks is one small unit of work, so a
       bucket of any size spreads over all tasks. A pair counts in its lowest shared bucket alone. MinHash values are
       compared some at a time, pairs whose posterior probability of reaching the threshold is below `tolerance`
       go, and the rest are verified on the whole sets. No pair leaves its task.
    4. Units return link counts and least sets; connected links give the classes of the result.

    Returns a row a row of docs: doc_id, text_key (xxhash64 of the text), class_id (least id of the documents connected
    by links), set_id (least id with the same shingle set), n_links (other documents linked to this one, copies
    included), n_shingles, kept (whether this id and text stand for the class: those of its least id, then least
    text_key, are chosen). A text of fewer than five words is one shingle; one without words, null or empty, has no
    links and is kept. Every row is a document: rows that repeat an id are judged by their own texts, rows that repeat
    id and text count as copies of each other and are all kept or none. Ids that are null come after all others:
    class_id and set_id are null only where every id is. An empty table gives no rows; other columns of docs are
    ignored. Nothing is capped.
    """
    n = partitions(docs.sparkSession)
    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketches = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "text").mapInArrow(sketch, SKETCH), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    alike = sketches.where("n > 0").groupBy("one", "two", "n")
    sets = written(alike.agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("set_id"), F.min(first).alias("first"), F.any_value("bands").alias("bands")), "sets")
    units = F.array_sort(F.collect_list(F.struct("band", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks")))).alias("units")  # a unit a band at most
    placed = buckets(sets).groupBy("rep").agg(units, F.bit_or(F.expr("shiftleft(1L, band)")).alias("own"))
    number = lambda c: F.coalesce(c, F.lit(NO_ID))
    placed = placed.join(sets.select("rep", "copies", number(F.col("first.doc_id")).alias("id"), F.col("first.text_key").alias("text_key")), "rep")
    placed = written(placed, "placed")
    text = rows.select(number(F.col("doc_id")).alias("id"), "text_key", "text").join(placed.select("id", "text_key").hint("merge"), ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"])
    whole = placed.join(text.hint("merge"), ["id", "text_key"]).select("rep", "copies", "units", "own", "text").mapInArrow(sets_of, PLACED)
    dealt = whole.select("rep", "copies", "own", "values", "set", F.explode("units").alias("u")).select("*", F.pmod(F.xxhash64("rep"), F.col("u.blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("u.blocks") - 1)).alias("k"))
    dealt = dealt.select(F.col("u.key").alias("key"), F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), F.col("u.band").alias("band"), "block", "rep", "copies", "own", "values", "set")
    work = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = written(work.mapInArrow(lambda b: join_blocks(b, threshold, tolerance), LINKS), "links")
    discard(placed)
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "root")
    count = links.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = count.join(roots, "rep", "left").select("rep", "links", F.coalesce("root", "rep").alias("root")).join(sets.select("rep", "set_id", "first"), "rep")
    whole_class = linked.groupBy("root").agg(F.min("set_id").alias("class_id"), F.min("first").alias("chosen"))
    linked = linked.select("rep", "links", "root").join(whole_class, "root").drop("root")
    told = sets.select("one", "two", "n", "rep", "copies", "set_id", "first").join(linked, "rep", "left")
    told = told.select("one", "two", "n", "set_id", F.when(F.col("links").isNull(), F.col("set_id")).otherwise(F.col("class_id")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("chosen", "first").alias("chosen"))
    found = sketches.select("doc_id", "text_key", "n", "one", "two").join(written(told, "classes").hint("merge"), ["one", "two", "n"], "left")
    kept = F.col("chosen").isNull() | (F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_key") == F.col("chosen.text_key")))
    lone = F.col("n") == 0
    return found.select(
        "doc_id", "text_key", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(lone, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("n").alias("n_shingles"), kept.alias("kept"),
    )


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_key")
