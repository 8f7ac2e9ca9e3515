"""Search terms: the `text::order` notation, variants, n-grams, correction, and last-wins de-duplication.

Terms of a query are expanded on the driver and travel with the tasks; those of a table are bounded by their size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATOR = "::"


class Term(NamedTuple):
    """order 0 is what was asked for; higher orders weigh less."""

    text: str
    order: int = 0
    ref_ids: tuple[str, ...] | None = None


def grams(word: str, least: int = 5) -> list[str]:
    if len(word) < least:
        return [word]
    n = 5 if len(word) >= 9 else 4 if len(word) >= 7 else 3
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def parse(strings: Iterable[str], ref_ids: Iterable[str] | None = None) -> list[Term]:
    """`text::order` with exactly one separator; anything else is its first part at order 0."""
    refs = tuple(ref_ids) if ref_ids is not None else None
    out = []
    for s in strings:
        parts = s.split(SEPARATOR)
        out.append(Term(parts[0], int(parts[1]), refs) if len(parts) == 2 else Term(parts[0], 0, refs))
    return out


def variants(text: str, case_sensitive: bool = False, correct: Callable[[str], str | None] | None = None) -> list[str]:
    """Other spellings of a term: its corrected words (changed ones alone), then lower, upper and title case."""
    out = []
    changed = [c for w in re.findall(r"\w+", text) if correct and (c := correct(w)) is not None and c != w]
    if changed:
        out.append(" ".join(changed))
    if not case_sensitive:
        out += [v for v in (text.lower(), text.upper(), text.title()) if v != text]
    return out


def expand(text: str, case_sensitive: bool = False, correct: Callable[[str], str | None] | None = None, ref_ids: Iterable[str] | None = None) -> list[Term]:
    """The term at order 0, each variant at 1, and each variant's n-grams at 2."""
    refs = tuple(ref_ids) if ref_ids is not None else None
    out = [Term(text, 0, refs)]
    for v in variants(text, case_sensitive, correct):
        out += [Term(v, 1, refs), *(Term(g, 2, refs) for g in grams(v))]
    return out


def prepare(strings: Iterable[str], exact: bool = True, case_sensitive: bool = False, correct: Callable[[str], str | None] | None = None, ref_ids: Iterable[str] | None = None) -> list[Term]:
    """Terms of a query: parsed as they are (without ref_ids) in exact mode, else expanded."""
    if exact:
        return parse(strings)
    return [t for s in strings for t in expand(s, case_sensitive, correct, ref_ids)]


#: Bytes of the texts of a table's terms: they travel with the tasks, so a table of more is refused.
MOST_TERM_BYTES = 64 << 20


def from_table(rows: DataFrame, text_col: str = "text", order_col: str | None = None) -> list[Term]:
    """The distinct terms of a table (of equal texts, the least order); null and empty texts are none. Their size is checked before they come to the driver."""
    order = F.min(F.col(order_col).cast("int")) if order_col else F.lit(0)
    found = rows.select(F.col(text_col).cast("string").alias("text"), *([order_col] if order_col else [])).where("text <> ''").groupBy("text").agg(order.alias("order"))
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_TERM_BYTES:
        raise ValueError(f"terms of {size} bytes; a search takes {MOST_TERM_BYTES}")
    return [Term(r["text"], r["order"]) for r in found.orderBy("text").collect()]


def last_wins(terms: Iterable[Term]) -> list[Term]:
    """One term a text, the last of equal ones; empty texts go."""
    return list({t.text: t for t in terms if t.text}.values())


def frame(spark: SparkSession, terms: Iterable[Term]) -> DataFrame:
    rows = [(i, t.order, t.text, list(t.ref_ids) if t.ref_ids is not None else None) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "seq int, order int, text string, ref_ids array<string>")


def last_wins_frame(terms: DataFrame) -> DataFrame:
    latest = Window.partitionBy("text").orderBy(F.desc("seq"))
    return terms.where("text <> ''").withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn")


#: Letters of a word whose deletions are indexed: two words within d edits have a common rest of these letters less at most d, however long they are.
INDEXED_LETTERS = 10


def deletions(word: Column, most: int) -> Column:
    """The first INDEXED_LETTERS of a word, and what is left of them without one letter, two, up to `most`."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    level = F.array(F.substring(word, F.lit(1), F.lit(INDEXED_LETTERS)))
    found = [level]
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda w: F.length(w) > 0), less)))
        found.append(level)
    return F.array_distinct(F.concat(*found))


def correction_index(frequencies: DataFrame, most: int = 2) -> DataFrame:
    """(key, known, n): the deletions of every known word; made once and kept as a table, it corrects many queries."""
    return frequencies.where("word <> ''").select(F.explode(deletions(F.col("word"), most)).alias("key"), F.col("word").alias("known"), "n")


def corrections(words: DataFrame, frequencies: DataFrame, most: int = 2, index: DataFrame | None = None) -> DataFrame:
    """(word, correction): the known word within `most` edits, nearest first, then most frequent, then first by name.

    words (a query's, or a whole table's) and known words meet on equal deletions, so no word is compared with the
    whole dictionary; each candidate's edits are counted. A word without a candidate stays as it is. index: a kept
    correction_index of the same frequencies and `most`.
    """
    asked = words.select("word").where("word IS NOT NULL").distinct()
    keyed = asked.select("word", F.explode(deletions(F.col("word"), most)).alias("key"))
    near = keyed.join(correction_index(frequencies, most) if index is None else index, "key").where(F.abs(F.length("known") - F.length("word")) <= most).select("word", "known", "n").distinct()
    apart = F.levenshtein(F.col("word"), F.col("known"), most)
    best = near.where(apart >= 0).groupBy("word").agg(F.min(F.struct(apart.alias("d"), (-F.col("n")).alias("m"), F.col("known").alias("known"))).alias("best"))
    return asked.join(best, "word", "left").select("word", F.coalesce("best.known", "word").alias("correction"))


def corrector(spark: SparkSession, strings: Iterable[str], frequencies: DataFrame, most: int = 2, index: DataFrame | None = None) -> Callable[[str], str | None]:
    """What expand takes as `correct`: the corrections of the words of a query's strings."""
    asked = sorted({w for s in strings for w in re.findall(r"\w+", s)})
    found = corrections(spark.createDataFrame([(w,) for w in asked], "word string"), frequencies, most, index).collect()  # a row a word of the query
    return {r["word"]: r["correction"] for r in found}.get
