"""Exact dedup over an extendible-hash index on shared files, in DataFrame operations alone."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import discard, partitions, table, texts, written

#: Distinct keys a bucket holds before it splits.
CAPACITY = 1 << 14
#: A directory of up to 2 ** 16 slots (two longs and an int each, about 1 MB) is sent to the tasks; a larger one is joined by slot.
SENT_BITS = 16


def prefix(h: Column, bits: int) -> Column:
    """The first `bits` bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, local_bits) of the index over distinct keys (h), and the number of bits of a slot.

    It starts at the depth at which buckets would be full if keys were even. While a bucket holds more than
    `capacity` keys, the directory doubles: overfull buckets split on one more bit, the others keep theirs
    and are pointed to by several slots. Every level is a table in the shared folder; only overfull buckets' keys
    are counted again.
    """
    bits = max(0, math.ceil(math.log2(max(1, keys.count()) / capacity)))
    counted = lambda rows: written(rows.groupBy(prefix(F.col("h"), bits).alias("prefix")).agg(F.count("*").alias("n")), "buckets")
    levels = [counted(keys)]
    leaves = [levels[0].where(F.col("n") <= capacity).select("prefix", F.lit(bits).alias("local_bits"))]
    while not (full := levels[-1].where(F.col("n") > capacity)).isEmpty():
        up = prefix(F.col("h"), bits).alias("up")
        bits += 1
        levels.append(counted(keys.select("h", up).join(full.select(F.col("prefix").alias("up")), "up", "left_semi")))
        leaves.append(levels[-1].where(F.col("n") <= capacity).select("prefix", F.lit(bits).alias("local_bits")))
    all_ = leaves[0]
    for x in leaves[1:]:
        all_ = all_.unionByName(x)
    wide = F.expr(f"shiftleft(1L, {bits} - local_bits)")
    slots = written(all_.select(F.explode(F.sequence(F.col("prefix") * wide, (F.col("prefix") + 1) * wide - 1)).alias("slot"), (F.col("prefix") * wide).alias("bucket"), "local_bits"), "directory")
    discard(*levels)
    return slots, bits


def located(rows: DataFrame, slots: DataFrame, bits: int, sent_bits: int = SENT_BITS) -> DataFrame:
    """rows (with h) and the bucket that the directory has for them."""
    known = slots.select("slot", "bucket")
    return rows.withColumn("slot", prefix(F.col("h"), bits)).join(F.broadcast(known) if bits <= sent_bits else known, "slot").drop("slot")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.xxhash64, sent_bits: int = SENT_BITS) -> DataFrame:
    """Group of equal texts of every row; of each group the row with the largest id stays.

    1. The distinct keys (64-bit hashes) of all rows make the directory of an extendible-hash index, which doubles
       until no bucket is overfull. There is no largest size: beyond 2 ** sent_bits slots it is joined, not sent.
    2. Every row goes to the bucket that its slot points to. Within a bucket, texts of one key are compared byte by
       byte (the grouping is by bucket, key and text), so texts that share a key stay apart, each a link of the
       key's chain. Links combine in each task before they are dealt: a text that a third of all rows have costs
       a row a task.
    3. Owner tasks take ranges of buckets, number the links of each chain, and the index goes to shared files.
    4. Every row finds its bucket in the directory and its link by key and digest. A hot link is one row on one
       side, so that join splits.

    Returns doc_id, keep_id, group_size, kept, text_sha256, bucket, chain (place of the link among the texts of one key).
    Null text equals empty text. Rows with a null id never stay while a row with an id is there. Rows that
    repeat both id and text can't be told apart: all of them count, and all of the kept id say kept.
    An empty table gives no rows; other columns of docs are ignored.
    """
    rows = texts(docs, id_col, text_col).withColumn("h", key(F.col("text")))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    keyed = written(rows.select("doc_id", "h", digest), "keys")
    distinct = written(keyed.select("h").distinct(), "hashes")
    slots, bits = directory(distinct, capacity)
    links = located(rows, slots, bits, sent_bits).groupBy("bucket", "h", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    links = written(links.select("bucket", "h", digest, "keep_id", "group_size"), "links")
    owned = links.repartitionByRange(partitions(docs.sparkSession), "bucket", "h")
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256"))
    index = written(owned.withColumn("chain", chain), "index")
    discard(distinct, links)
    found = located(keyed, slots, bits, sent_bits).join(index, ["bucket", "h", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("bucket", "chain")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
