"""Phrase collocations: identical pieces are counted once, n-grams out-of-core in duckdb for each hash bucket."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import LOWER, ODD, discard, flat, hashes, mix, partitions, pieces, ragged, table, written

#: Words of the longest phrase, least occurrences, per cent of a phrase's occurrences that a longer one takes over, phrases of each language.
LONGEST, LEAST, COVERED, MOST = 4, 30, 80, 2000
#: Bytes of text whose phrases one bucket counts; duckdb spills what is above its memory to the task's own scratch folder.
BUCKET_BYTES, BUCKET_MEMORY = 2 << 30, "160MB"
#: Bytes of text of one share of the pieces, of pieces whose phrases are combined at a time, and of strings that a task holds before it sends them.
SHARE_BYTES, PIECES_BYTES, TASK_BYTES = 64 << 20, 2 << 20, 20 << 20
#: Salts of the first round of ranking: a language has MOST rows of each in the second.
SALTS = 64

BLANK, STOP = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[9, 32]] = True
STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets, text number, words) of the pieces of texts, with one blank between words and after the last."""
    low = LOWER[data]
    stop = STOP[low]
    inside = ~(stop | BLANK[low])
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]] & ~edge[:-1]
    after = np.r_[inside[1:], False] & ~edge[1:]
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, begin, side="right") - 1
    stops = np.r_[0, np.cumsum(stop)]
    new = np.ones(len(begin), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (stops[begin[1:]] != stops[end[:-1]])
    size = end - begin + 1
    out = np.append(low, np.uint8(32))[ragged(begin, size)]
    out[np.cumsum(size) - 1] = 32
    first = np.flatnonzero(new)
    return out, np.r_[np.r_[0, np.cumsum(size)][first], len(out)], doc[first], np.diff(np.r_[first, len(begin)])


def equal_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads of the runs of equal 128-bit keys in it); a chance clash of a alone cuts a run, which is no error."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)


def two_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each string, made in blocks that bound the memory of their chunks."""
    blocks = list(pieces(np.r_[0, np.cumsum(size)], 1 << 20))
    return [np.concatenate([hashes(data[start[i] : start[j - 1] + size[j - 1]], start[i:j] - start[i], size[i:j], seed) for i, j in blocks] or [np.zeros(0, np.uint64)]) for seed in (0, 1)]


def strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings data[start : start + size], copied in blocks that bound the memory of their places."""
    bounds = np.r_[0, np.cumsum(size)]
    out = np.empty(int(bounds[-1]), np.uint8)
    for i, j in pieces(bounds, 1 << 20):
        out[bounds[i] : bounds[j]] = data[ragged(start[i:j], size[i:j])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(out))


#: packed: strings of a bucket with their counts, as compressed Arrow; or, where answers is true, 64-bit hashes.
PACKED = "bucket int, share int, answers boolean, packed binary"
FIELDS = pa.schema([("text", pa.large_string()), ("n", pa.int64())])
#: Strings are a language, a tab, and a piece or phrase, which has no tab; an empty phrase counts all words.
TAB = 9


class Packer:
    """Strings with their counts, by hash bucket: a row of PACKED holds those of a task."""

    def __init__(self, buckets: int, share: int = -1):
        self.buckets, self.share, self.size = buckets, share, 0
        self.held: dict[int, list[pa.RecordBatch]] = {}

    def add(self, key: np.ndarray, text: pa.Array, n: np.ndarray) -> None:
        """key: hashes of the strings, ascending."""
        bucket = (key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        cut = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True]) if len(key) else np.zeros(1, np.int64)
        made = pa.record_batch([text, pa.array(n)], schema=FIELDS)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            self.held.setdefault(int(bucket[a]), []).append(made.slice(a, b - a))
        self.size += made.nbytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        for bucket, parts in self.held.items():
            yield packed_row(bucket, self.share, False, pack(parts))
        self.held.clear()
        self.size = 0


def pack(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, FIELDS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(pa.Table.from_batches(parts).combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, counts) of packed strings."""
    read = pa.ipc.open_stream(packed).read_all()
    return *flat(read.column("text")), np.asarray(read.column("n").combine_chunks())


def packed_row(bucket: int, share: int, answers: bool, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([share], pa.int32()), pa.array([answers]), pa.array([packed], pa.binary())], names=["bucket", "share", "answers", "packed"])


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def dealt(packed: DataFrame, buckets: int, *then) -> DataFrame:
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", *then)


def distinct_pieces(rows: DataFrame, shares: int) -> DataFrame:
    """PACKED, where bucket is a share: the distinct pieces of (lang, text), each in one share, and how often they occur.

    Each task combines the equal pieces of a batch, so a piece that a third of all rows hold sends a string a batch;
    the tasks of the shares combine these.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(shares)
        for batch in batches:
            whole, every = flat(batch.column(1))
            for i, j in pieces(every, 2 << 20):
                lang = batch.column(0).slice(i, j - i).dictionary_encode()
                number = np.asarray(lang.indices)
                out, at, doc, _ = cut_pieces(whole[every[i] : every[j]], every[i : j + 1] - every[i])
                size = np.diff(at) - 1
                named, named_at = flat(lang.dictionary)
                seed = hashes(named, named_at[:-1], np.diff(named_at))[number[doc]]
                key = [mix(h ^ seed) for h in two_hashes(out, at[:-1], size)]
                order, head = equal_runs(*key)
                one = order[head]
                names = lang.dictionary.take(pa.array(number[doc[one]])).cast(pa.large_string())
                packer.add(key[0][one], pc.binary_join_element_wise(names, strings(out, at[one], size[one]), pa.scalar("\t", pa.large_string())), np.diff(np.r_[head, len(order)]))
                if packer.size > TASK_BYTES:
                    yield from packer.rows()
        yield from packer.rows()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, group in groupby(each_row(batches), lambda r: r[0]):
            data, sizes, times = zip(*((d, np.diff(o), n) for d, o, n in (unpack(r[3]) for r in group)))
            data, size, times = np.concatenate(data), np.concatenate(sizes), np.concatenate(times)
            start = np.cumsum(size) - size
            order, head = equal_runs(*two_hashes(data, start, size))
            one = order[head]
            n = np.add.reduceat(times[order], head) if len(head) else times
            for i, j in pieces(np.r_[0, np.cumsum(size[one])], PIECES_BYTES):
                part = one[i:j]
                yield packed_row(share, share, False, pack([pa.record_batch([strings(data, start[part], size[part]), pa.array(n[i:j])], schema=FIELDS)]))

    return dealt(rows.mapInArrow(cut, PACKED), shares).mapInArrow(combine, PACKED)


class Phrases:
    """Words and phrases of pieces (or phrases), strings of FIELDS."""

    def __init__(self, texts: np.ndarray, offsets: np.ndarray):
        n = np.diff(offsets)
        self.at = np.r_[0, np.cumsum(n + 1)]
        self.data = np.full(int(self.at[-1]), 32, np.uint8)
        self.data[ragged(self.at[:-1], n)] = texts
        tabs = np.flatnonzero(self.data == TAB)
        self.tab = tabs[np.searchsorted(tabs, self.at[1:]) - 1] if len(n) else tabs  # the last one ends the language
        blank = np.flatnonzero(self.data == 32)
        piece = np.searchsorted(self.at, blank, side="right") - 1
        inner = blank > self.tab[piece]
        self.blank, self.piece = blank[inner], piece[inner]
        new = np.r_[True, self.piece[1:] != self.piece[:-1]] if len(self.piece) else np.zeros(0, bool)
        self.begin = np.where(new, self.tab[self.piece] + 1, np.r_[0, self.blank[:-1] + 1] if len(self.blank) else self.blank)
        self.last = np.searchsorted(self.blank, self.at[1:]) - 1
        seed = hashes(self.data, self.at[:-1], self.tab - self.at[:-1])[self.piece]
        self.word = two_hashes(self.data, self.begin, self.blank - self.begin)
        self.run = [mix(x ^ seed) for x in self.word]
        self.place = np.arange(len(self.begin))

    def longer(self, k: int) -> None:
        """run and place (hashes and first words of phrases of k words) go on to k + 1 words."""
        ok = self.place + k <= self.last[self.piece[self.place]]
        self.place = self.place[ok]
        self.run = [mix(r[ok] * np.uint64(ODD) + w[self.place + k]) for r, w in zip(self.run, self.word)]

    def keep(self, kept: np.ndarray) -> None:
        self.place, self.run = self.place[kept], [r[kept] for r in self.run]

    def strings(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """Languages, tabs and phrases."""
        piece = self.piece[first]
        named = strings(self.data, self.at[piece], self.tab[piece] + 1 - self.at[piece])
        return pc.binary_join_element_wise(named, strings(self.data, self.begin[first], self.blank[last] - self.begin[first]), pa.scalar("", pa.large_string()))

    def total(self, times: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Languages and tabs (empty phrases), and how many words they have."""
        names = strings(self.data, self.at[:-1], self.tab + 1 - self.at[:-1]).dictionary_encode()
        words = np.bincount(self.piece, minlength=len(times)) * times
        n = np.zeros(len(names.dictionary), np.int64)
        np.add.at(n, np.asarray(names.indices), words)
        return names.dictionary, n


def add_phrases(to: Packer, phrases: Phrases, found: list[tuple[int, np.ndarray, list[np.ndarray]]], times: np.ndarray) -> None:
    """The distinct ones of found (words less one, first words, hashes), with their sums."""
    first, last = np.concatenate([p for _, p, _ in found]), np.concatenate([p + k for k, p, _ in found])
    a, b = (np.concatenate([r[i] for _, _, r in found]) for i in (0, 1))
    order, head = equal_runs(a, b)
    one = order[head]
    n = np.add.reduceat(times[phrases.piece[first[order]]], head) if len(head) else np.zeros(0, np.int64)
    to.add(a[one], phrases.strings(first[one], last[one]), n)


def short_phrases(distinct: DataFrame, buckets: int) -> DataFrame:
    """PACKED: words and pairs of words of each share's pieces with their sums, and empty phrases that count all words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, group in groupby(each_row(batches), lambda r: r[1]):
            packer = Packer(buckets, share)
            for _, _, _, packed in group:
                data, offsets, times = unpack(packed)
                phrases = Phrases(data, offsets)
                found = [(0, phrases.place, phrases.run)]
                phrases.longer(1)
                add_phrases(packer, phrases, [*found, (1, phrases.place, phrases.run)], times)
                names, n = phrases.total(times)
                named, named_at = flat(names)
                key = hashes(named, named_at[:-1], np.diff(named_at))
                order = np.argsort(key)
                packer.add(key[order], names.take(pa.array(order)), n[order])
                if packer.size > TASK_BYTES:
                    yield from packer.rows()
            yield from packer.rows()

    return distinct.mapInArrow(task, PACKED)


def long_phrases(distinct: DataFrame, answers: DataFrame, buckets: int, shares: int, longest: int) -> DataFrame:
    """PACKED: phrases of 3 to `longest` words of each share's pieces, of which all pairs of neighbours are frequent.

    answers tell each share the hashes of its frequent pairs; they come before its pieces. A chance clash of hashes
    adds a phrase whose count decides as any other's.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for _, group in groupby(each_row(batches), lambda r: r[0]):
            told, frequent = [np.zeros(0, np.uint64)], None
            for _, _, is_answer, packed in group:
                if is_answer:
                    told.append(np.frombuffer(packed, np.uint64))
                    continue
                if frequent is None:
                    frequent = np.sort(np.concatenate(told))
                data, offsets, times = unpack(packed)
                phrases = Phrases(data, offsets)
                phrases.longer(1)
                at = np.minimum(np.searchsorted(frequent, phrases.run[0]), max(len(frequent) - 1, 0))
                good = frequent[at] == phrases.run[0] if len(frequent) else np.zeros(len(at), bool)
                pair = np.zeros(len(phrases.begin) + 1, bool)
                pair[phrases.place[good]] = True
                phrases.keep(good)
                found = []
                for k in range(2, longest):
                    phrases.longer(k)
                    phrases.keep(pair[phrases.place + k - 1])
                    found.append((k, phrases.place, phrases.run))
                add_phrases(packer, phrases, found, times)
                if packer.size > TASK_BYTES:
                    yield from packer.rows()
        yield from packer.rows()

    return dealt(distinct.unionByName(answers), shares, F.desc("answers")).mapInArrow(task, PACKED)


def pair_hashes(texts: pa.Array) -> np.ndarray:
    """The hashes of pairs of words that Phrases gives them."""
    phrases = Phrases(*flat(texts))
    phrases.longer(1)
    return phrases.run[0]


def counted(packed: DataFrame, buckets: int, least: int, tell: bool) -> DataFrame:
    """PACKED phrases -> PACKED, each task streaming a bucket into duckdb, which counts out-of-core.

    Rows without answers hold the phrases of `least` occurrences, and the empty ones. If it is to tell, each share
    gets the hashes of the frequent pairs of words that it has (bucket is then the share).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in groupby(each_row(batches), lambda r: r[0]):

            def stream() -> Iterator[pa.RecordBatch]:
                for _, share, _, grams in group:
                    for part in pa.ipc.open_stream(grams):
                        yield part.append_column("share", pa.array(np.full(part.num_rows, share, np.int32)))

            with tempfile.TemporaryDirectory(dir=".") as scratch, duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as db:
                source = pa.RecordBatchReader.from_batches(FIELDS.append(pa.field("share", pa.int32())), stream())  # noqa: F841  (duckdb reads it by name)
                if tell:
                    db.sql("CREATE TEMP TABLE told AS SELECT * FROM source")
                db.sql(f"CREATE TEMP TABLE often AS SELECT text, CAST(sum(n) AS BIGINT) AS n FROM {'told' if tell else 'source'} GROUP BY text HAVING sum(n) >= {int(least)} OR ends_with(text, chr({TAB}))")
                for part in db.sql("SELECT text, n FROM often").to_arrow_reader(200_000):
                    yield packed_row(bucket, -1, False, pack([part.cast(FIELDS)]))
                if tell:
                    pairs = db.sql(f"SELECT DISTINCT share, text FROM told JOIN (SELECT text FROM often WHERE contains(regexp_extract(text, '[^' || chr({TAB}) || ']*$'), ' ')) USING (text) ORDER BY share").to_arrow_reader(200_000)
                    for part in pairs:
                        share, key = np.asarray(part.column("share")), pair_hashes(part.column("text"))
                        cut = np.flatnonzero(np.r_[True, share[1:] != share[:-1], True]) if len(share) else np.zeros(1, np.int64)
                        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                            yield packed_row(int(share[a]), int(share[a]), True, key[a:b].tobytes())

    return dealt(packed, buckets, "share").mapInArrow(task, PACKED)


def phrase_counts(counts: DataFrame) -> DataFrame:
    """(lang, gram, f) of packed counts; the words of a language have an empty gram."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, packed in each_row(batches):
            for part in pa.ipc.open_stream(packed):
                yield pa.RecordBatch.from_arrays([part.column("text").cast(pa.string()), part.column("n")], names=["text", "f"])

    read = counts.where("NOT answers").mapInArrow(task, "text string, f long")
    half = lambda k: F.regexp_extract("text", r"(?s)^(.*)\t([^\t]*)$", k)
    return read.select(half(1).alias("lang"), half(2).alias("gram"), "f")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, most: int = MOST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z), cut into pieces at marks and line ends, and those into words at blanks. a, l and r
    count the phrase and the parts of its lowest-scoring cut, n all words of the language; the score is
    floor(2000000 a / (l + r)). A phrase goes if a longer phrase that holds it occurs `covered` per cent as often.
    Ties: the first cut; the rank goes by score, a, then phrase. Null texts are empty, a null language is `und`, and
    repeated rows count each; an empty table gives no rows.

    Words and pairs are counted first. A phrase of `least` occurrences has parts that occur as often, so longer ones
    are counted only where all pairs in them are frequent, which each share of the pieces is told. Then each phrase
    sends a lookup request for every part, and requests meet the counts by a shuffle.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    shares = max(partitions(spark), math.ceil(total / SHARE_BYTES))
    buckets = max(partitions(spark), math.ceil(total / BUCKET_BYTES))
    distinct = written(distinct_pieces(rows, shares), "pieces")
    tables = [distinct, written(counted(short_phrases(distinct, buckets), buckets, least, longest > 2), "short_phrases")]
    if longest > 2:
        tables.append(written(counted(long_phrases(distinct, tables[1].where("answers"), buckets, shares, longest), buckets, least, False), "long_phrases"))
    counts = written(reduce(DataFrame.unionByName, map(phrase_counts, tables[1:])), "phrase_counts")
    discard(*tables)
    all_words = counts.where("gram = ''").select("lang", F.col("f").alias("n"))
    grams = counts.where("gram <> ''")
    phrases = grams.where(F.contains("gram", F.lit(" "))).select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.split("gram", " ").alias("words"))
    part = lambda i, n: F.array_join(F.slice("words", i, n), " ")
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    asked = phrases.select("lang", "phrase", "a", "words", cut).select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("k")).alias("gram")), F.struct(F.lit(1).alias("side"), part(F.col("k") + 1, F.size("words")).alias("gram")))).alias("ask"))
    told = asked.select("lang", "phrase", "a", "k", "ask.side", "ask.gram").join(grams.hint("merge"), ["lang", "gram"])
    sides = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))").cast("long")
    lowest = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # the parts of a phrase that have two words or more learn how often the longer phrase occurs
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    longer = phrases.where(F.size("words") > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(20,0)")
    left = lowest.join(longer, ["lang", "phrase"], "left").where(F.lit(100) * wide(F.col("longer")) < F.lit(covered) * wide(F.col("a")))
    flat_ = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = (F.desc("score"), F.desc("a"), "phrase")
    salted = flat_.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= most).drop("rank", "salt")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws, count(*) AS t FROM p GROUP BY ALL),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS gram, CAST(sum(t) AS BIGINT) AS f FROM (SELECT lang, ws, t, k, unnest(range(1, len(ws) - k + 2)) AS i FROM q, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, gram, f AS a, string_split(gram, ' ') AS ws FROM g WHERE k > 1 AND f >= 30),
x AS (SELECT lang, gram, a, ws, unnest(range(1, len(ws))) AS i FROM c),
y AS (SELECT x.lang, x.gram, a, i, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM x JOIN g l ON l.lang = x.lang AND l.gram = array_to_string(ws[1:i], ' ') JOIN g r ON r.lang = x.lang AND r.gram = array_to_string(ws[i + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, i) = 1),
s AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS gram, max(a) AS longer FROM (SELECT lang, ws, a, k, unnest(range(1, len(ws) - k + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS k) WHERE len(ws) > k) GROUP BY 1, 2),
o AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.gram) AS rank FROM z LEFT JOIN s USING (lang, gram) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, gram AS phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""
