"""Fill-in-middle by a parallel automaton scan: chunks emit transition functions that compose in any grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import discard, flat, partitions, pieces, table, texts, written

#: Bytes of one chunk, all of which are stepped at once.
CHUNK = 256
#: A text of more bytes is cut into parts of PART_BYTES, which are dealt to all tasks.
GIANT_BYTES, PART_BYTES = 8 << 20, 1 << 20
#: Per cent of the texts that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 90, 20

# States of the automaton over bytes: outside letters, in letters, after '<', after '<' and a marker's letter (in letters too).
STATES = 4
OTHER, LETTER, MARK, LESS, GREATER, REST, NONE = range(7)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[[ord(c) for c in "PSM"]] = MARK
CLASS[ord("<")], CLASS[ord(">")] = LESS, GREATER
CLASS[128:192] = REST  # of a character of several bytes
NEXT = np.zeros((STATES, 8), np.uint8)
NEXT[:, LETTER] = NEXT[:, MARK] = 1
NEXT[2, MARK] = 3
NEXT[:, LESS] = 2
NEXT[:, [REST, NONE]] = np.arange(STATES)[:, None]
#: Tokens that begin with a byte in a state; markers that end with it count 2 ** 32 each.
MARKER = 1 << 32
COUNT = np.zeros((STATES, 8), np.int64)
COUNT[:, [OTHER, LESS, GREATER]] = 1
for _state in (0, 2):
    COUNT[_state, [LETTER, MARK]] = 1
COUNT[3, GREATER] += MARKER


class Scan:
    """The automaton over several texts (or parts of texts) at once.

    Each chunk is a function from its entry state to its exit state and its counts. Functions compose associatively,
    so a text's prefix functions come by doubling, whatever the entry state of the text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        per = np.maximum(1, -(-sizes // CHUNK))
        self.first = np.r_[0, np.cumsum(per)]
        self.owner = np.repeat(np.arange(len(sizes)), per)
        number = np.arange(len(self.owner)) - self.first[self.owner]
        self.begin = offsets[self.owner] + number * CHUNK
        size = np.minimum(CHUNK, offsets[self.owner + 1] - self.begin)
        kinds = np.full((len(self.owner), CHUNK), NONE, np.uint8)
        place = np.arange(CHUNK)
        kinds[place < size[:, None]] = CLASS[data[offsets[0] : offsets[-1]]]
        self.kinds = kinds
        end = np.tile(np.arange(STATES, dtype=np.uint8), (len(kinds), 1))
        count = np.zeros(end.shape, np.int64)
        for column in np.ascontiguousarray(kinds.T):
            key = end * np.uint8(8) + column[:, None]
            count += COUNT.ravel()[key]
            end = NEXT.ravel()[key]
        head = self.first[self.owner]
        step, most = 1, int(per.max(initial=1))
        while step < most:
            later = np.flatnonzero(np.arange(len(end)) - step >= head)
            e, c = compose((end[later - step], count[later - step]), (end[later], count[later]))
            end[later], count[later] = e, c
            step *= 2
        #: Of all chunks of the text up to this one: exit state and counts, by the text's entry state.
        self.end, self.count = end, count

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The function of each text."""
        last = self.first[1:] - 1
        return self.end[last], self.count[last]

    def places(self, text: np.ndarray, entry: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Bytes at which tokens begin: of each text, entered in a state, the token of that number (from 0); its end if it has no such token."""
        total = (self.count[self.first[text + 1] - 1, entry] % MARKER).astype(np.int64)
        out = self.begin[self.first[text + 1] - 1] + (self.kinds[self.first[text + 1] - 1] != NONE).sum(axis=1)
        some = np.flatnonzero(token < total)
        low, high = self.first[text[some]], self.first[text[some] + 1] - 1
        while (low < high).any():  # the first chunk by whose end more tokens have begun
            middle = (low + high) // 2
            enough = self.count[middle, entry[some]] % MARKER > token[some]
            high, low = np.where(enough, middle, high), np.where(enough, low, np.minimum(middle + 1, high))
        inner = low > self.first[text[some]]
        state = np.where(inner, self.end[np.maximum(low - 1, 0), entry[some]], entry[some]).astype(np.uint8)
        left = token[some] - np.where(inner, self.count[np.maximum(low - 1, 0), entry[some]] % MARKER, 0)
        begins = np.zeros((len(some), CHUNK), bool)
        for j, column in enumerate(np.ascontiguousarray(self.kinds[low].T)):
            key = state * np.uint8(8) + column
            begins[:, j] = COUNT.ravel()[key] % MARKER
            state = NEXT.ravel()[key]
        out[some] = self.begin[low] + (np.cumsum(begins, axis=1) > left[:, None]).argmax(axis=1)
        return out


def compose(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """f, then g; rows are functions, columns entry states."""
    via = f[0].astype(np.int64)
    return np.take_along_axis(g[0], via, axis=1), f[1] + np.take_along_axis(g[1], via, axis=1)


def cuts(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before the first cut and before the second."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def digits(seed: str, key: Column) -> list[Column]:
    """The first four groups of eight hex digits of the sha256 of `seed:key`, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
FORMS = np.array(["plain", "psm", "spm"], object)


def formed(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, n: np.ndarray, marks: np.ndarray, first: np.ndarray, second: np.ndarray, plain: int, suffix_first: int) -> pa.RecordBatch:
    """Rows of the batch (doc_id, text, h1 .. h4) cut at the bytes `first` and `second`."""
    h3, h4 = np.asarray(batch.column(4)), np.asarray(batch.column(5))
    stays = (np.diff(offsets) == 0) | (marks > 0) | (h3 % 100 >= plain)
    form = np.where(stays, 0, np.where(h4 % 100 < suffix_first, 2, 1))
    points = np.r_[0, np.cumsum(data.view(np.int8) >= -64)]
    raw, out = data.tobytes(), []
    for f, a, p, m, b in zip(form.tolist(), offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist()):
        if f == 0:
            out.append(raw[a:b])
        elif f == 1:
            out.append(b"".join((b"<P>", raw[a:p], b"<S>", raw[m:b], b"<M>", raw[p:m])))
        else:
            out.append(b"".join((b"<S>", raw[m:b], b"<P>", raw[a:p], b"<M>", raw[p:m])))
    chars = lambda x: pa.array(x, pa.int64(), mask=stays)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(n, pa.int64()), pa.array(FORMS[form].tolist(), pa.string()), chars(points[first] - points[offsets[:-1]]), chars(points[second] - points[first]), pa.array(out, pa.binary()).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def giant_cuts(giants: DataFrame, part_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, digest, n, marks, first, second) of giants (doc_id, text, h1 .. h4, digest): bytes at which they are cut; and the tables to discard.

    Parts are dealt to all tasks and emit their functions, a row of four states each. A text has a row a part, which
    compose in its task; the parts that hold a cut are asked for its place. Rows of equal id and text are cut alike.
    """
    spark = giants.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i in range(batch.num_rows):
                for k, at in enumerate(range(int(offsets[i]), int(offsets[i + 1]), part_bytes)):
                    own = data[at : min(at + part_bytes, int(offsets[i + 1]))].tobytes()
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in (0, 6, 2, 3)), pa.array([k], pa.int32()), pa.array([own], pa.binary())], names=["doc_id", "digest", "h1", "h2", "part", "data"])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(5))
            ends, counts = Scan(data, offsets).whole()
            lists = [pa.array(x.tolist(), kind) for x, kind in ((ends, pa.list_(pa.int32())), (counts, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *lists], names=["doc_id", "digest", "h1", "h2", "part", "ends", "counts"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                state, before = 0, [0]
                entries = []
                for p in r["parts"]:
                    entries.append(state)
                    before.append(before[-1] + p["counts"][state])
                    state = p["ends"][state]
                tokens = np.array([x % MARKER for x in before])
                n = int(tokens[-1])
                for which, at in enumerate(cuts(np.int64(n), np.int64(r["h1"]), np.int64(r["h2"]))):
                    k = min(int(np.searchsorted(tokens, at, side="right")) - 1, len(entries) - 1)
                    out.append((r["doc_id"], r["digest"], which, k, entries[k], int(at - tokens[k]), n, before[-1] // MARKER))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names=["doc_id", "digest", "which", "part", "entry", "token", "n", "marks"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(7))
            at = Scan(data, offsets).places(np.arange(batch.num_rows), np.asarray(batch.column(4)), np.asarray(batch.column(5))) - offsets[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 2)), batch.column(6), batch.column(8), pa.array(at + np.asarray(batch.column(3)).astype(np.int64) * part_bytes)], names=["doc_id", "digest", "which", "n", "marks", "at"])

    kept = written(giants.mapInArrow(cut, "doc_id long, digest string, h1 long, h2 long, part int, data binary").repartition(partitions(spark), "digest", "part"), "fim_parts")
    of_parts = kept.mapInArrow(functions, "doc_id long, digest string, h1 long, h2 long, part int, ends array<int>, counts array<long>").dropDuplicates(["doc_id", "digest", "part"])
    by_text = of_parts.groupBy("doc_id", "digest", "h1", "h2").agg(F.array_sort(F.collect_list(F.struct("part", "ends", "counts"))).alias("parts"))
    asked = written(by_text.mapInArrow(choose, "doc_id long, digest string, which int, part int, entry int, token long, n long, marks long"), "fim_cuts")
    own = kept.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), F.col("part").alias("number"), "data")
    held = asked.join(own, asked["doc_id"].eqNullSafe(own["id"]) & (asked["digest"] == own["of"]) & (asked["part"] == own["number"]))
    found = held.select("doc_id", "digest", "which", "part", "entry", "token", "n", "data", "marks").mapInArrow(find, "doc_id long, digest string, which int, n long, marks long, at long")
    at = lambda k: F.min(F.when(F.col("which") == k, F.col("at")))
    return found.groupBy("doc_id", "digest").agg(F.first("n").alias("n"), F.first("marks").alias("marks"), at(0).alias("first"), at(1).alias("second")), [kept, asked]


def fill_in_middle(docs: DataFrame, seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, giant_bytes: int = GIANT_BYTES, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text.

    Tokens are runs of ASCII letters and single other characters. Two cuts, drawn by a hash of seed and id, part a text
    into prefix, middle and suffix; form says how output holds them (plain: as it was; its chars are null). A text
    that has a marker stays plain, so restored() gives every text back. Null texts are empty and plain; a null id is
    hashed as an empty one; repeated rows give a row each; an empty table gives none.
    """
    rows = texts(docs, id_col, text_col).select("doc_id", "text", *digits(seed, F.col("doc_id")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, every = flat(batch.column(1))
            for i, j in pieces(every, 2 << 20):
                data, offsets, part = whole[every[i] : every[j]], every[i : j + 1] - every[i], batch.slice(i, j - i)
                scan = Scan(data, offsets)
                count = scan.whole()[1][:, 0]
                n, zero = count % MARKER, np.zeros(j - i, np.int64)
                a, b = cuts(n, np.asarray(part.column(2)), np.asarray(part.column(3)))
                yield formed(part, data, offsets, n, count // MARKER, scan.places(np.arange(j - i), zero, a), scan.places(np.arange(j - i), zero, b), plain, suffix_first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            n, marks, a, b = (np.asarray(batch.column(c)) for c in range(6, 10))
            for i in range(batch.num_rows):  # a giant at a time
                own = slice(int(offsets[i]), int(offsets[i + 1]))
                yield formed(batch.slice(i, 1), data[own], offsets[i : i + 2] - offsets[i], n[i : i + 1], marks[i : i + 1], a[i : i + 1], b[i : i + 1], plain, suffix_first)

    small = rows.where(F.octet_length("text") <= giant_bytes).mapInArrow(task, FORMED)
    giants = rows.where(F.octet_length("text") > giant_bytes)
    if giants.isEmpty():
        return small
    giants = giants.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    found, tables = giant_cuts(giants, part_bytes)
    kept = written(found.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "n", "marks", "first", "second"), "fim_found")
    discard(*tables)
    large = giants.join(kept, giants["doc_id"].eqNullSafe(kept["id"]) & (giants["digest"] == kept["of"])).select("doc_id", "text", "h1", "h2", "h3", "h4", "n", "marks", "first", "second")
    return small.unionByName(large.mapInArrow(cut, FORMED))


def restored(output: Column, form: Column) -> Column:
    """The text of an output, read back from its markers."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
f AS (SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
      CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
