"""Multi-pattern matching: every occurrence of every term, overlapping, case-sensitive, at 0-based code points."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.arrow import flat, pieces
from loam.operators.automaton import TABLE_BYTES, Automaton, grouped
from loam.operators.terms import Term, last_wins

MATCHES = "array<struct<pos:int,term:string,order:int,line:int>>"
_kind = pa.list_(pa.struct([("pos", pa.int32()), ("term", pa.string()), ("order", pa.int32()), ("line", pa.int32())]))


class Found(NamedTuple):
    """Matches of several texts, in the order of text and end (of equal ends, the longer term first): text number, term
    number, code point in the text, 1-based line; and the code points of each text."""

    doc: np.ndarray
    term: np.ndarray
    pos: np.ndarray
    line: np.ndarray
    length: np.ndarray


#: Bytes a core at which a scan is left as it is.
SPREAD_BYTES = 64 << 20


def where(mask: np.ndarray) -> np.ndarray:
    """Places at which a mask of a multiple of eight values is set; those of a thin mask by its words first."""
    words = np.flatnonzero(mask.view(np.uint64))
    if 16 * len(words) > len(mask):
        return np.flatnonzero(mask)
    found = np.flatnonzero(mask.reshape(-1, 8)[words].ravel())
    return (words[found >> 3] << 3) + (found & 7)


#: Distinct beginnings (two bytes) that are looked for one by one; more terms are found by an automaton.
FEW_HEADS = 4


class Finder:
    """Finds terms in the bytes of many texts at once.

    An automaton steps over whole batches, so a byte costs the same whatever the number of terms (of TABLE_BYTES of
    transitions; terms of more take a pass each). For a few terms it is cheaper still to compare whole batches with
    the two bytes at which they begin, and their other bytes at those places alone.
    """

    def __init__(self, terms: Iterable[Term]):
        self.terms = last_wins(terms)
        self.words = [np.frombuffer(t.text.encode(), np.uint8) for t in self.terms]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.order = np.array([t.order for t in self.terms], np.int32)
        self.texts = pa.array([t.text for t in self.terms], pa.string())
        #: Term numbers by their first two bytes; a term of one byte has that alone.
        self.heads: dict[tuple[int, ...], list[int]] = {}
        for k, w in enumerate(self.words):
            self.heads.setdefault(tuple(w[:2].tolist()), []).append(k)
        self.automata: list[tuple[np.ndarray, Automaton]] | None = None

    def by_heads(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, places at which they begin)."""
        most, n = int(self.size.max()), -(-len(data) // 8) * 8
        padded = np.concatenate((data, np.zeros(n - len(data) + most + 1, np.uint8)))
        first, then = padded[:n], padded[1 : n + 1]
        for head, terms in self.heads.items():
            place = where(first == head[0]) if len(head) == 1 else where((first == head[0]) & (then == head[1]))
            for k in terms:
                at = place
                for i in range(2, len(self.words[k])):
                    at = at[padded[at + i] == self.words[k][i]]
                yield np.full(len(at), k, np.int32), at

    def by_automata(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.automata is None:
            self.automata = [(np.array(own, np.int32), Automaton([self.words[k] for k in own])) for own in grouped(self.words, TABLE_BYTES // 4)]
        for own, automaton in self.automata:
            word, end = automaton.ends(data)
            term = own[word]
            yield term, end - self.size[term]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, lines: bool = True) -> Found:
        """Matches in the texts data[offsets[i] : offsets[i + 1]]; their lines are left at 0 where none are asked."""
        starts, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        if self.terms and len(data):
            for term, at in (self.by_heads if len(self.heads) <= FEW_HEADS else self.by_automata)(data):
                starts.append(at)
                numbers.append(term)
        start, term = np.concatenate(starts), np.concatenate(numbers)
        end = start + self.size[term] if len(term) else start
        most = int(self.size.max(initial=1))
        if len(starts) != 2 or len(self.heads) <= FEW_HEADS:
            order = np.argsort(end * (most + 1) + most - (end - start), kind="stable")  # ends ascend with the texts
            start, end, term = start[order], end[order], term[order]
        doc = np.searchsorted(offsets, start, side="right") - 1
        inside = end <= offsets[doc + 1] if len(start) else np.zeros(0, bool)
        start, term, doc = start[inside], term[inside], doc[inside]
        pos, length = start - offsets[doc], np.diff(offsets)
        padded = np.concatenate((data, np.zeros(-len(data) % 8, np.uint8))) if len(data) % 8 else data
        if len(data) and data.max() >= 128:  # bytes that continue a character are no code points
            more = where(padded.view(np.int8) < -64)
            before = np.searchsorted(more, offsets)
            pos, length = pos - np.searchsorted(more, start) + before[doc], length - np.diff(before)
        line = np.zeros(len(start), np.int64)
        if lines:
            breaks = where(padded == 10)
            line = np.searchsorted(breaks, start) - np.searchsorted(breaks, offsets)[doc] + 1
        return Found(doc, term, pos, line, length)

    def column(self, found: Found) -> pa.Array:
        """The matches of each text as a list column."""
        bounds = np.searchsorted(found.doc, np.arange(len(found.length) + 1))
        struct = pa.StructArray.from_arrays([pa.array(found.pos, pa.int32()), self.texts.take(pa.array(found.term)), pa.array(self.order[found.term]), pa.array(found.line, pa.int32())], fields=list(_kind.value_type))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows over all cores where a scan has fewer files than cores and little to read (a file of one row group is one task); else as they are, unmoved. The order of rows is not kept."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    small = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores * SPREAD_BYTES
    return rows.repartition(cores, key) if small and len(rows.inputFiles()) < cores else rows


def match(docs: DataFrame, terms: Iterable[Term], text_col: str = "text") -> DataFrame:
    """docs with a column `matches` (pos, term, order, 1-based line), in the order of the matches' ends.

    One pass over each text whatever the number of terms (see Finder); nothing is shuffled. The other columns ride along
    in Arrow batches, so select what is needed first. A null text has no matches.
    """
    terms = last_wins(terms)
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"matches {MATCHES}"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(terms)
        for batch in batches:
            data, offsets = flat(pc.fill_null(batch.column(at), ""))
            for i, j in pieces(offsets):
                found = find(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, find.column(found)], names=[*batch.schema.names, "matches"])

    return docs.mapInArrow(task, schema)


def positions(docs: DataFrame, terms: Iterable[Term], key: str, text_col: str = "text") -> DataFrame:
    """(key, term, pos) in the JVM alone, by splitting each text at each term; exact for terms of which no proper prefix is a suffix.

    The pieces of a text are rows, and a running sum of their lengths gives the places: linear in the text. key is unique.
    """
    each = F.explode(F.array(*(F.lit(t.text) for t in last_wins(terms))))
    pieces_ = docs.select(key, text_col, each.alias("term")).where(F.contains(text_col, F.col("term")))
    pieces_ = pieces_.select(key, "term", F.posexplode(F.split(text_col, F.concat(F.lit("\\Q"), "term", F.lit("\\E")), -1)).alias("i", "piece"))
    sized = pieces_.select(key, "term", "i", F.length("piece").cast("long").alias("n"), F.length("term").alias("m"))
    order = Window.partitionBy(key, "term").orderBy("i")
    ends = sized.select(key, "term", (F.sum(F.col("n") + F.col("m")).over(order) - F.col("m")).alias("pos"), F.lead("i").over(order).alias("next"))
    return ends.where("next IS NOT NULL").drop("next")


def exploded(matched: DataFrame, *keys: str) -> DataFrame:
    """A row a match: (keys, pos, term, order, line)."""
    return matched.select(*keys, F.explode("matches").alias("m")).select(*keys, "m.pos", "m.term", "m.order", "m.line")


def term_counts(matches: Column) -> Column:
    """Map from term to its number of matches."""
    names = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["term"])))
    return F.map_from_arrays(names, F.transform(names, lambda t: F.size(F.filter(matches, lambda m: m["term"] == t)).cast("long")))
