"""Cross-entropy difference of documents under a target and a background n-gram model over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import flat, pieces, table, texts

#: Tokens are bytes, so both models share a closed vocabulary; beside them there is the start of a text, and trigrams have a proven bound of 257 ** 3.
VOCABULARY, START = 256, 256
SYMBOLS = VOCABULARY + 1
#: Weight of the shorter context in each estimate.
PRIOR = 8.0
#: Seed of the background's draw, and of the folds.
SEED = 17

COUNTS = "model int, fold int, code int, n long"


def contexts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram code of every byte: the two symbols before it in its text (START where there is none), then itself."""
    padded = np.concatenate((np.full(2, START, np.int32), data.astype(np.int32)))
    one, two = padded[1:-1].copy(), padded[:-2].copy()
    starts = offsets[:-1][np.diff(offsets) > 0]
    one[starts] = START
    two[starts] = START
    second = starts + 1
    two[second[second < len(data)]] = START
    return (two * SYMBOLS + one) * SYMBOLS + padded[2:]


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (model, fold, text) -> trigram counts of the task by model and fold."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        code = np.concatenate([c for c, _ in parts])
        values, place = np.unique(code, return_inverse=True)
        return values, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        group = np.asarray(batch.column(0)) * 2 + np.asarray(batch.column(1))
        data, offsets = flat(batch.column(2))
        for i, j in pieces(offsets, 2 << 20):
            code = contexts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            of = np.repeat(group[i:j], np.diff(offsets[i : j + 1]))
            for g in np.unique(of).tolist():
                parts = held.setdefault(g, [])
                parts.append(np.unique(code[of == g], return_counts=True))
                if len(parts) > 16:
                    held[g] = [merged(parts)]
    for g, parts in held.items():
        code, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), g // 2, np.int32)), pa.array(np.full(len(code), g % 2, np.int32)), pa.array(code.astype(np.int32)), pa.array(n)], names=["model", "fold", "code", "n"])


@dataclass
class Models:
    #: Place of each symbol in the cubes; the last place is that of the symbols that no model saw.
    place: np.ndarray
    size: int
    #: -log2 p(c | a b) by fold, a, b, c, as one row: of a fold's documents, learnt from the other fold.
    target: np.ndarray
    background: np.ndarray


def losses(code: np.ndarray, n: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """-log2 p(c | a b) for all places a, b, c, as a cube.

    Each estimate leans on that of the shorter context with weight PRIOR; the shortest is add-one over VOCABULARY.
    """
    cube = np.zeros((size, size, size), np.float32)
    np.add.at(cube, (place[code // SYMBOLS**2], place[code // SYMBOLS % SYMBOLS], place[code % SYMBOLS]), n)
    two = cube.sum(axis=0, dtype=np.float64)
    one = two.sum(axis=0)
    p = (one + 1) / (one.sum() + VOCABULARY)
    p = (two + PRIOR * p) / (two.sum(axis=1, keepdims=True) + PRIOR)
    total = cube.sum(axis=2, keepdims=True, dtype=np.float64).astype(np.float32)
    cube += (PRIOR * p).astype(np.float32)  # in place: a cube is the largest thing that the driver holds
    cube /= total + np.float32(PRIOR)
    np.log2(cube, out=cube)
    np.negative(cube, out=cube)
    return cube


SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double, favoured double"


def fold() -> Column:
    """0 or 1 by a hash of the id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)).cast("int")


def members(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(model, fold, text): every document that the target names as model 0, and as model 1 the background, drawn from all documents by a hash of the id at the rate at which its expected bytes match the target's.

    The target's ids grow with the documents, so that join is by merge at every size; the background takes none.
    """
    named = target.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    sizes = docs.select("doc_id", F.octet_length("text").alias("size"))
    whole, own = (x.agg(F.sum("size")).first()[0] or 0 for x in (sizes, sizes.join(named.hint("merge"), "doc_id", "left_semi")))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(own / max(whole, 1) * (1 << 30))
    chosen = docs.join(named.hint("merge"), "doc_id", "left_semi").select(F.lit(0).alias("model"), fold().alias("fold"), "text")
    return chosen.unionByName(docs.where(F.coalesce(F.col("doc_id").isNotNull() & drawn, F.lit(False))).select(F.lit(1).alias("model"), fold().alias("fold"), "text"))


def train(docs: DataFrame, target: DataFrame) -> Models:
    """Models from (doc_id, text) and the target's doc_id; each fold's are learnt from the other fold's documents, so none is scored by what it taught.

    Counts cover the whole texts of all members, are summed in each task, then by trigram; at most 4 * 257 ** 3
    sums, in practice those of the bytes in use, come to the driver.
    """
    rows = members(docs, target).mapInArrow(count, COUNTS).groupBy("model", "fold", "code").agg(F.sum("n").alias("n")).toArrow()
    model, of, code, n = (np.asarray(rows.column(k)) for k in ("model", "fold", "code", "n"))
    letters = np.unique(np.concatenate((np.full(1, START), code // SYMBOLS**2, code // SYMBOLS % SYMBOLS, code % SYMBOLS)))
    size = len(letters) + 1
    place = np.full(SYMBOLS, size - 1)
    place[letters] = np.arange(len(letters))
    cubes = []
    for m in (0, 1):
        cubes.append(np.concatenate([losses(code[own], n[own], place, size).ravel() for own in ((model == m) & (of == 1 - k) for k in (0, 1))]))
    return Models(place, size, *cubes)


def score(docs: DataFrame, models: Models) -> DataFrame:
    """Mean losses per byte, the mean of their differences (below 0: closer to the target), and the share of bytes that the target's model gives less loss."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # four cubes of at most 258 ** 3 floats

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place, size = m.place, m.size
        for batch in batches:
            of = np.asarray(batch.column(1)).astype(np.int64)
            data, offsets = flat(batch.column(2))
            for i, j in pieces(offsets, 1 << 20):
                own = offsets[i : j + 1] - offsets[i]
                n = np.diff(own)
                code = contexts(data[offsets[i] : offsets[j]], own)
                at = ((np.repeat(of[i:j], n) * size + place[code // SYMBOLS**2]) * size + place[code // SYMBOLS % SYMBOLS]) * size + place[code % SYMBOLS]
                target, background = m.target[at], m.background[at]
                means = [np.diff(np.r_[0.0, np.cumsum(x, dtype=np.float64)][own]) / np.maximum(n, 1) for x in (target, background, target - background, target < background)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *(pa.array(x) for x in means)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score", "favoured"])

    return docs.select("doc_id", fold().alias("fold"), "text").mapInArrow(task, SCORED)


def lm_score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score, favoured of every whole text; target: a table with doc_id.

    The score is the mean of the per-token loss differences. A null or empty text has no tokens and 0 in all columns.
    Rows that repeat are counted and scored each; a row without an id is scored and teaches nothing. A byte that no
    model saw is a symbol of its own, not the start of a text. Without a target, or without documents, models are even
    over the vocabulary. Other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    return score(rows, train(rows, target))


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
