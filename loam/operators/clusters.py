"""Word clusters of the best results, and the search that follows from the best cluster."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.results import search, with_contexts
from loam.operators.terms import Term

# The English stop words of the usual public list that have five characters or more and no apostrophe.
STOP_WORDS = (
    "about", "above", "after", "again", "against", "because", "before", "being", "below", "between", "couldn", "doesn", "doing", "during",
    "further", "haven", "having", "herself", "himself", "itself", "mightn", "mustn", "myself", "needn", "other", "ourselves", "should", "shouldn",
    "their", "theirs", "themselves", "there", "these", "those", "through", "under", "until", "weren", "where", "which", "while", "wouldn",
    "yours", "yourself", "yourselves",
)
#: Results that are mined, words that are combined, words of a cluster, clusters returned.
RESULTS, MOST_WORDS, SIZES, TOP = 4, 50, (2, 3, 4), 10


def top_results(results: DataFrame, n: int = RESULTS) -> DataFrame:
    """The n best results; equal scores by uri."""
    return results.orderBy(F.desc(F.round("score", 9)), "uri").limit(n)


def word_frequency(results: DataFrame, text_cols: Iterable[str] = ("title", "matches_with_context"), least: int = 5) -> DataFrame:
    """(word, n) of words of letters and digits with `least` characters, in lower case, stop words apart, over the given text (or list of texts) columns."""
    told = [F.col(c) if results.schema[c].dataType.typeName() == "array" else F.array(c) for c in text_cols]
    words = results.select(F.explode(F.concat(*told)).alias("text")).select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("word")).where(F.length("word") >= least)
    return words.select(F.lower("word").alias("word")).where(~F.col("word").isin(*STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))


def word_clusters(results: DataFrame, text_cols: Iterable[str] = ("title", "matches_with_context"), least: int = 5) -> DataFrame:
    """(cluster, score): the best combinations of two to four of the most frequent words by mean frequency.

    At most MOST_WORDS words, whatever the input, come to the driver, and are combined from there: the search is
    planned and run once, and the joins below have a fixed size.
    """
    ranked = word_frequency(results, text_cols, least).orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()
    words = results.sparkSession.createDataFrame([(i, r["word"], r["n"]) for i, r in enumerate(ranked)], "i int, word string, n long").coalesce(1)
    combos = words.select(F.array("word").alias("words"), F.col("n").alias("total"), F.col("i").alias("last"))
    out = None
    for size in SIZES:
        combos = combos.join(F.broadcast(words), F.col("i") > F.col("last")).select(F.array_append("words", F.col("word")).alias("words"), (F.col("total") + F.col("n")).alias("total"), F.col("i").alias("last"))
        part = combos.select("words", (F.col("total") / size).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("score"), F.desc("words")).limit(TOP).select(F.array_join("words", " ").alias("cluster"), F.round("score", 6).alias("score"))


def derivative_search(docs: DataFrame, terms: Iterable[Term], min_score: float = 1.0, columns: Iterable[str] = ("n", "score")) -> DataFrame:
    """A second search: the words of the first search's best cluster."""
    best = word_clusters(top_results(with_contexts(docs, terms, min_score=min_score))).first()
    return search(docs, [Term(w) for w in best["cluster"].split()] if best else [], min_score=min_score, columns=columns)
