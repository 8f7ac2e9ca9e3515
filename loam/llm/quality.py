"""Quality by a sparse rule ensemble: paths of trees over text statistics are rules, lasso logistic weights choose among them, Spark columns apply them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import LOWER, flat, hashes, pieces, table, texts, written

#: Labelled rows that the trees and weights are fitted to, at most in expectation.
SAMPLE_ROWS = 200_000
TREES, DEPTH, PENALTY, SEED = 30, 3, 0.002, 7
#: Statistics of a text, each from all its bytes; shares are of its characters, words or lines.
STATISTICS = (
    "log_chars", "letters", "upper", "digits", "symbols", "marks", "exclaims", "log_words", "word_size", "short_words", "wordless", "symbol_ends", "titled",
    "repeats_last", "distinct_words", "top_word", "log_lines", "words_a_line", "distinct_lines",
)

_byte = np.arange(256)
LETTERS = (_byte >= 65) & (_byte < 91) | (_byte >= 97) & (_byte < 123) | (_byte >= 128)
UPPER, DIGITS, BLANKS = (_byte >= 65) & (_byte < 91), (_byte >= 48) & (_byte < 58), (_byte == 32) | (_byte >= 9) & (_byte < 14)
MARKS, EXCLAIMS = np.isin(_byte, [ord(c) for c in ".,;:?'\"-()"]), _byte == ord("!")
SYMBOLS = (_byte > 32) & (_byte < 127) & ~(LETTERS | DIGITS | MARKS | EXCLAIMS)


def largest_group(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its distinct keys, and how often the most frequent occurs."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[head], np.diff(np.r_[head, len(key)]))
    return np.bincount(owner[head], minlength=n), most


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """STATISTICS of several texts; all are 0 where there is nothing to count."""
    n = len(offsets) - 1
    sums = lambda mask: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.r_[0, np.cumsum(mask)])
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    first_byte = data.view(np.int8) >= -64
    chars = sums(first_byte)
    letters, upper = sums(LETTERS[data] & first_byte), sums(UPPER[data])
    inside = ~BLANKS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside & ~(np.r_[False, inside[:-1]] & ~edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & ~(np.r_[inside[1:], False] & ~edge[1:])) + 1 if len(data) else begin
    doc = np.searchsorted(offsets, begin, side="right") - 1
    words = np.bincount(doc, minlength=n)
    places = np.r_[0, np.cumsum(first_byte)]
    size = places[end] - places[begin]
    lettered = np.r_[0, np.cumsum(LETTERS[data])]
    of_words = lambda mask: share(np.bincount(doc[mask], minlength=n), words)
    key = hashes(LOWER[data], begin, end - begin)
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    distinct, most = largest_group(doc, key, n)
    line_end = np.flatnonzero((data == 10) | edge[1:])
    line_begin = np.r_[0, line_end[:-1] + 1] if len(line_end) else line_end
    line_doc = np.searchsorted(offsets, line_begin, side="right") - 1
    full = words_between(begin, line_begin, line_end + 1) > 0
    line_doc, line_key = line_doc[full], hashes(data, line_begin[full], line_end[full] + (data[line_end[full]] != 10) - line_begin[full])
    lines = np.bincount(line_doc, minlength=n)
    different, _ = largest_group(line_doc, line_key, n)
    return [
        np.log1p(chars), share(letters, chars), share(upper, letters), share(sums(DIGITS[data]), chars), share(sums(SYMBOLS[data]), chars), share(sums(MARKS[data]), chars), share(sums(EXCLAIMS[data]), chars),
        np.log1p(words), share(np.bincount(doc, weights=size, minlength=n), words), of_words(size <= 3), of_words(lettered[end] == lettered[begin]), of_words(SYMBOLS[data[end - 1]] if len(end) else end > 0), of_words(UPPER[data[begin]] if len(begin) else begin > 0),
        of_words(again), share(distinct, words), share(most, words), np.log1p(lines), share(words, lines), share(different, lines),
    ]


def words_between(begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.searchsorted(begin, high) - np.searchsorted(begin, low)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATISTICS as floats) of every whole text; a null text is empty and has zeros."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets, 2 << 20):
                found = statistics_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, pa.float64()) for x in found)], names=["doc_id", *STATISTICS])

    return texts(docs, id_col, text_col).mapInArrow(task, ", ".join(["doc_id long", *(f"{s} double" for s in STATISTICS)]))


class Rule(NamedTuple):
    """A conjunction: low < statistic <= high for each of `bounds` (statistic, low, high)."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        parts = [F.col(s) > low for s, low, _ in self.bounds if low != -np.inf] + [F.col(s) <= high for s, _, high in self.bounds if high != np.inf]
        return reduce(lambda a, b: a & b, parts)


def rules_of(tree: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The paths to all nodes of a tree, from its printed form."""
    out, path = [], []
    for line in tree.splitlines():
        if not (m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)):
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, s, sign, at in path:
            low, high = bounds.get(s, (-np.inf, np.inf))
            bounds[s] = (low, min(high, at)) if sign == "<=" else (max(low, at), high)
        out.append(Rule(tuple((s, *b) for s, b in sorted(bounds.items()))))
    return out


class Ensemble(NamedTuple):
    base: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Chance of label 1, from 0 to 1, as a column over STATISTICS."""
        parts = [F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.weights]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(self.base))))


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = SEED) -> Ensemble:
    """Rules and weights from (STATISTICS, label 0 or 1), `rows` of them at most in expectation, drawn by a hash of all columns.

    Equal rows are drawn together, but each of them counts. Rows without a label are left out. Of one label only, the
    score is its constant chance (smoothed by one row of each); without rows, a half.
    """
    known = labelled.where(F.col("label").isin(0, 1)).select(*STATISTICS, F.col("label").cast("double").alias("label"))
    counts = {int(r[0]): r[1] for r in known.groupBy("label").agg(F.count("*")).collect()}
    total, ones = sum(counts.values()), counts.get(1, 0)
    if len(counts) < 2:
        return Ensemble(float(np.log((ones + 1) / (total - ones + 1))), ())
    draw = F.pmod(F.xxhash64(*STATISTICS), F.lit(1 << 30)) < int(min(1.0, rows / total) * (1 << 30))
    sample = written(known.where(draw), "labelled")  # trees and weights are fitted to the same rows
    if sample.select("label").distinct().count() < 2:
        return Ensemble(float(np.log((ones + 1) / (total - ones + 1))), ())
    vectors = sample.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=seed, minInstancesPerNode=5).fit(vectors)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in rules_of(tree.toDebugString)))
    if not rules:
        return Ensemble(float(np.log((ones + 1) / (total - ones + 1))), ())
    held = sample.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(held)
    return Ensemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels are never learnt from: crc32 of the id as text leaves 1 by three (null ids among them)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text: the chance that labels (doc_id, quality) mark it 1, and whether it is a half or more.

    One pass over the texts makes their statistics, a small table in the shared folder, which labelled ids of
    `learn_from` (a condition over doc_id) join and the rules score in the JVM. A document with several labels counts
    once for each. Null texts are empty and scored like others; repeated rows are scored each; an empty table gives
    no rows.
    """
    found = written(statistics(docs, id_col, text_col), "statistics")
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(learn_from)
    model = fit(found.join(told, "doc_id"), rows)
    scored = found.select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_quality(spark, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
