"""A stored trigram index: texts in blocks (a file each), and the blocks of every trigram, so that a search reads only blocks that may have a hit."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.arrow import flat
from loam.operators.results import search
from loam.operators.terms import Term, last_wins
from loam.sources import tables

#: Bytes of text of a block: what a search with one hit reads at least.
BLOCK_BYTES = 64 << 20
#: Trigrams of a query up to which the postings are filtered by a list, which prunes their files; more are joined.
MOST_LISTED = 2000
#: Trigrams of a block that wait to be told once (16 MB).
MOST_HELD = 4 << 20


def trigrams(data: np.ndarray) -> np.ndarray:
    """Three bytes each, as numbers, at every place of data but the last two."""
    wide = data.astype(np.int32)
    return wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]


def of_term(text: str) -> list[int]:
    return np.unique(trigrams(np.frombuffer(text.encode(), np.uint8))).tolist()


def postings(texts: DataFrame) -> DataFrame:
    """(gram, block) of texts (block long, text): a task tells the trigrams of a block once; a block of several tasks has some of them more often."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0  # of the block that the last row was of; rows of one file follow each other
        for batch in batches:
            block = np.asarray(batch.column(0))
            data, offsets = flat(batch.column(1))
            for i, name in enumerate(block.tolist()):
                if name != last:
                    yield from told(last, held)
                    last, held, size = name, [], 0
                if offsets[i + 1] - offsets[i] > 2:
                    held.append(trigrams(data[offsets[i] : offsets[i + 1]]))
                    size += len(held[-1])
                    if size > MOST_HELD:
                        held = [np.unique(np.concatenate(held))]
                        size = 0
        yield from told(last, held)

    def told(name: int | None, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            gram = np.unique(np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(np.full(len(gram), name, np.int64))], names=["gram", "block"])

    return texts.mapInArrow(task, "gram int, block long")


def store(docs: DataFrame, root: str, block_bytes: int = BLOCK_BYTES, uri_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes texts and their index below root, as new versions; gives the number of blocks.

    Texts are dealt by ranges of their uri to blocks of about `block_bytes`, one file each. Postings are dealt and sorted by
    trigram, so a filter of them reads a few row groups; a block is a hash of its file's name in them, and a table has
    the names of each hash. Null texts are empty; an empty table has no blocks.
    """
    rows = docs.select(F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tables.commit(rows.repartitionByRange(max(1, math.ceil(total / block_bytes)), "uri"), f"{root}/texts")
    spark = docs.sparkSession
    texts = tables.load(spark, f"{root}/texts")
    path = F.col("_metadata.file_path")
    tables.commit(texts.select(path.alias("path")).distinct().select(F.xxhash64("path").alias("block"), "path"), f"{root}/blocks")
    made = postings(texts.select(F.xxhash64(path).alias("block"), "text"))
    tables.commit(made.repartition("gram").sortWithinPartitions("gram", "block"), f"{root}/postings")
    return len(texts.inputFiles())


def blocks_of(spark: SparkSession, root: str, terms: Iterable[Term], all_terms: bool = False) -> list[str] | None:
    """Files that hold all trigrams of any term (of every term); None where a term is too short to tell.

    The files of an answer, not their texts, come to the driver; there is one for each `block_bytes` of text.
    """
    terms = last_wins(terms)
    grams = {k: of_term(t.text) for k, t in enumerate(terms) if len(t.text.encode()) > 2}
    if not grams or (len(grams) < len(terms) and not all_terms):
        return None if terms else []
    needed = [(g, k) for k, own in grams.items() for g in own]
    known = tables.load(spark, f"{root}/postings")
    listed = sorted({g for g, _ in needed})
    if len(listed) <= MOST_LISTED:
        known = known.where(F.col("gram").isin(listed))
    asked = spark.createDataFrame(needed, "gram int, term int")  # a query's terms
    sizes = spark.createDataFrame([(k, len(own)) for k, own in grams.items()], "term int, size int")
    whole = known.join(F.broadcast(asked), "gram").groupBy("block", "term").agg(F.count_distinct("gram").alias("n")).join(F.broadcast(sizes), "term").where("n = size")
    found = whole.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") >= (len(grams) if all_terms else 1))
    names = tables.load(spark, f"{root}/blocks").join(found, "block")
    return sorted(r["path"] for r in names.select("path").collect())


def indexed_search(spark: SparkSession, root: str, terms: Iterable[Term], all_terms: bool = False, **how) -> DataFrame:
    """The rows of results.search over the stored texts; blocks that hold no term (or not all, where all are asked) aren't read."""
    blocks, texts = blocks_of(spark, root, terms, all_terms), tables.load(spark, f"{root}/texts")
    if blocks is not None:
        texts = spark.read.schema(texts.schema).parquet(*blocks) if blocks else spark.createDataFrame([], texts.schema)
    return search(texts, terms, all_terms=all_terms, uri_col="uri", **how)
