"""Results of a search: line numbers, clusters of lines, snippets, AND searches, merging and order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.arrow import flat, pieces
from loam.operators import score
from loam.operators.match import MATCHES, Finder, Found, spread
from loam.operators.terms import Term, corrector, last_wins, prepare
from loam.session import written


def line_clusters(numbers: DataFrame, keys: list[str], context: int, line_col: str = "line") -> DataFrame:
    """(keys, first, last) of runs of lines, a gap of more than 2 * context to the line before begins a new one."""
    order = Window.partitionBy(*keys).orderBy(line_col)
    new = F.when(F.col(line_col) - F.lag(line_col).over(order) > 2 * context, 1).otherwise(0)
    run = numbers.select(*keys, line_col, new.alias("new")).withColumn("run", F.sum("new").over(order))
    return run.groupBy(*keys, "run").agg(F.min(line_col).alias("first"), F.max(line_col).alias("last")).drop("run")


def gather(numbers: list[int], context: int) -> list[tuple[int, int]]:
    """The same over one document's ascending line numbers."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and n - out[-1][1] <= 2 * context:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def snippet(rows: list[str], first: int, last: int, context: int) -> str:
    """Numbered lines from `context` before the first to `context` after the last."""
    return "\n".join(f"|{i}|    {rows[i - 1]}" for i in range(max(1, first - context), min(len(rows), last + context) + 1))


#: What a search can return of a document, beside its keys.
COLUMNS = {
    "text": "string", "matches": MATCHES, "n": "long", "score": "double", "search_term_match_counts": "map<string,bigint>", "line_numbers": "array<int>",
    "title": "string", "matches_with_context": "array<string>",
}
_blank = " \t\n\x0b\f\r"


def scan(rows: DataFrame, terms: Iterable[Term], columns: Iterable[str], text_col: str = "text", min_score: float = 1.0, all_terms: bool = False, noise: Iterable[str] = (), context: int = 16) -> DataFrame:
    """The other columns of rows and the asked COLUMNS, of the texts that match any term (or all) at `min_score` or more.

    One task of vector work a batch finds, scores and filters; only what is asked leaves it, and counts, lines and
    contexts are built for what is left alone. Nothing is shuffled.
    """
    terms, columns, noise = last_wins(terms), list(columns), list(noise)
    keys = [c for c in rows.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} {COLUMNS[c]}" for c in columns)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, lines = Finder(terms), bool({"matches", "line_numbers", "matches_with_context"} & set(columns))
        for batch in batches:
            data, offsets = flat(pc.fill_null(batch.column(len(keys)), ""))
            for i, j in pieces(offsets):
                found = find(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lines)
                distinct, points = score.of_texts(find, found, noise)
                count = np.bincount(found.doc, minlength=j - i)
                kept = np.flatnonzero((count > 0) & (points >= min_score) & (distinct >= (len(terms) if all_terms else 0)))
                part = batch.slice(i, j - i).take(pa.array(kept))
                bounds = np.searchsorted(found.doc, np.arange(j - i + 1))
                texts = part.column(len(keys)).to_pylist() if {"title", "matches_with_context"} & set(columns) else []
                numbers = [np.sort(found.line[bounds[k] : bounds[k + 1]]) for k in kept.tolist()] if {"line_numbers", "matches_with_context"} & set(columns) else []
                out = []
                for c in columns:
                    if c == "text":
                        out.append(part.column(len(keys)))
                    elif c == "matches":
                        out.append(find.column(found).take(pa.array(kept)))
                    elif c == "n":
                        out.append(pa.array(count[kept], pa.int64()))
                    elif c == "score":
                        out.append(pa.array(points[kept], pa.float64()))
                    elif c == "search_term_match_counts":
                        out.append(counts(find, found, kept))
                    elif c == "line_numbers":
                        out.append(pa.array(numbers, pa.list_(pa.int32())))
                    elif c == "title":
                        out.append(pa.array(["\n".join(x.removesuffix("\r") for x in t.split("\n", 5)[:5]).strip(_blank) for t in texts], pa.string()))
                    else:
                        out.append(pa.array([contexts(t, gather(n.tolist(), context), context) for t, n in zip(texts, numbers)], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *out], names=[*keys, *columns])

    return rows.select(*keys, text_col).mapInArrow(task, schema)


def counts(find: Finder, found: Found, kept: np.ndarray) -> pa.Array:
    """Map from term to its number of matches, terms in order, of the kept texts."""
    names = np.argsort(np.array([t.text for t in find.terms], object), kind="stable")
    place = np.empty(len(names), np.int64)
    place[names] = np.arange(len(names))
    pair, n = np.unique(found.doc * np.int64(len(names) + 1) + place[found.term], return_counts=True)
    doc, term = pair // (len(names) + 1), names[pair % (len(names) + 1)]
    low, high = np.searchsorted(doc, kept), np.searchsorted(doc, kept, side="right")
    at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)]) if len(kept) else np.zeros(0, np.int64)
    return pa.MapArray.from_arrays(pa.array(np.r_[0, np.cumsum(high - low)], pa.int32()), find.texts.take(pa.array(term[at])), pa.array(n[at], pa.int64()))


def contexts(text: str, clusters: list[tuple[int, int]], context: int) -> list[str]:
    whole = [x.removesuffix("\r") for x in text.split("\n")]
    return [snippet(whole, a, b, context) for a, b in clusters]


def search(docs: DataFrame, terms: Iterable[Term], min_score: float = 1.0, all_terms: bool = False, noise: Iterable[str] = (), uri_col: str = "doc_id", text_col: str = "text", columns: Iterable[str] = ("text", "matches", "n", "score"), context: int = 16) -> DataFrame:
    """(uri, asked columns) of documents that match any term (or all of them) at `min_score` or more.

    A scan of fewer tasks than cores is spread over them by uri; else nothing moves.
    """
    rows = spread(docs.select(F.col(uri_col).cast("string").alias("uri"), F.coalesce(text_col, F.lit("")).alias("text")), "uri")
    return scan(rows, terms, columns, "text", min_score, all_terms, noise, context)


def with_contexts(docs: DataFrame, terms: Iterable[Term], context: int = 16, **how) -> DataFrame:
    """Document results: (uri, score, search_term_match_counts, line_numbers, title, matches_with_context)."""
    return search(docs, terms, columns=("score", "search_term_match_counts", "line_numbers", "title", "matches_with_context"), context=context, **how)


def corrected_search(docs: DataFrame, strings: Iterable[str], frequencies: DataFrame, case_sensitive: bool = False, index: DataFrame | None = None, **how) -> DataFrame:
    """search() for strings as they are typed: the words of each are corrected by the known ones (word, n), then the strings are expanded."""
    strings = list(strings)
    return search(docs, prepare(strings, exact=False, case_sensitive=case_sensitive, correct=corrector(docs.sparkSession, strings, frequencies, index=index)), **how)


def bulk_search(docs: DataFrame, terms: Iterable[Term], context: int = 16, **how) -> DataFrame:
    """All document results, best first; equal scores by uri.

    The results are kept as a table before they are put in order, as the order samples its input: the texts are
    searched once.
    """
    return written(with_contexts(docs, terms, context, **how), "results").orderBy(F.desc("score"), "uri")


def merge(parts: DataFrame) -> DataFrame:
    """Partial results (uri, item, seq, term, n, score, content) by uri and item: counts summed, the first score, the last content; of equal seq, the least score and the greatest content."""
    counts = parts.groupBy("uri", "item", "term").agg(F.sum("n").alias("n"), F.min(F.struct("seq", "score")).alias("first"), F.max(F.struct("seq", "content")).alias("last"))
    return counts.groupBy("uri", "item").agg(
        F.sum("n").alias("n"), F.min("first")["score"].alias("score"), F.max("last")["content"].alias("content"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "n")))).alias("counts"),
    )
