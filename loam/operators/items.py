"""Items of delimited blocks: index, offsets, lookup of positions, and search.

A block is the text of consecutive rows, each ended by a break. Blocks are cut by an explicit number of rows, never by
free memory, so item numbers and scores do not depend on the machine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators import score
from loam.operators.clusters import top_results, word_clusters
from loam.operators.match import match, term_counts
from loam.operators.results import scan
from loam.operators.terms import Term, prepare

BREAK = "\r\n"


def delimited(rows: DataFrame, columns: list[str], key: str, file_id: str, per_block: int) -> DataFrame:
    """(file_id, block_id, seq, content) of table rows as delimited items, `per_block` keys a block."""
    content = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    return rows.select(F.lit(file_id).alias("file_id"), F.floor(F.col(key) / per_block).cast("long").alias("block_id"), F.col(key).cast("long").alias("seq"), content.alias("content"))


def index(items: DataFrame, brk: str = BREAK) -> DataFrame:
    """(file_id, block_id, item, start, end, content): half-open ranges of code points in each block; local numbers from 1.

    Every item has its own number, an unterminated last one too. Windows run within a block, so blocks are independent.
    """
    order = Window.partitionBy("file_id", "block_id").orderBy("seq")
    size = (F.length("content") + len(brk)).cast("long")
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return items.select("file_id", "block_id", F.row_number().over(order).cast("long").alias("item"), (end - size).alias("start"), end.alias("end"), "content")


def start_patterns(begin: str | None, brk: str = BREAK) -> tuple[str, str]:
    """(pattern of a valid item start at the head of a text, pattern of a break that a valid start or the end follows).

    begin: pattern of an item's start; None: every break ends an item. A pattern that does not compile is an error here, not in a task.
    """
    if begin is None:
        return "^", "\\Q" + brk + "\\E"
    re.compile(begin)
    return f"^(?:{begin})", "\\Q" + brk + f"\\E(?=(?:{begin})|\\z)"


def split_block(block: DataFrame, brk: str = BREAK, begin: str | None = None) -> DataFrame:
    """The same for blocks held as whole texts (file_id, block_id, text).

    begin: pattern of an item's start, for items whose text holds raw breaks. An item then ends only at a break that
    a valid start or the block's end follows; a block begins with an item whatever its text. Empty items have no
    number, and their breaks count in the places of what follows.
    """
    parts = block.select("file_id", "block_id", F.posexplode(F.split("text", start_patterns(begin, brk)[1], -1)).alias("seq", "content"))
    order = Window.partitionBy("file_id", "block_id").orderBy("seq")
    end = F.sum((F.length("content") + len(brk)).cast("long")).over(order)
    placed = parts.withColumn("end", end).where("content <> ''")
    return placed.select("file_id", "block_id", F.row_number().over(order).cast("long").alias("item"), (F.col("end") - F.length("content") - len(brk)).alias("start"), "end", "content")


def offsets(indexed: DataFrame) -> DataFrame:
    """(file_id, block_id, n, item_offset): items of all blocks before. Counts per block are summed before the window."""
    counts = indexed.groupBy("file_id", "block_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("item_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def numbered(indexed: DataFrame) -> DataFrame:
    """indexed with `global_item`, unique within a file."""
    return indexed.join(offsets(indexed).drop("n"), ["file_id", "block_id"]).withColumn("global_item", F.col("item_offset") + F.col("item")).drop("item_offset")


#: Positions of one bucket of the range join.
BUCKET = 4096


def positions_to_items(positions: DataFrame, indexed: DataFrame, inclusive: bool = False) -> DataFrame:
    """Each (file_id, block_id, pos) with its item; a position between items is dropped.

    A range join with an equal key: positions and item ranges are dealt to buckets of BUCKET code points, a range to
    each bucket that it touches. Half-open unless `inclusive`, where the end belongs to the item too.
    """
    last = F.col("end") if inclusive else F.col("end") - 1
    ranges = indexed.select("file_id", "block_id", "item", "start", "end", "content").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(last / BUCKET))))
    at = positions.withColumn("bucket", F.floor(F.col("pos") / BUCKET))
    upper = F.col("pos") <= F.col("end") if inclusive else F.col("pos") < F.col("end")
    return at.join(ranges, ["file_id", "block_id", "bucket"]).where((F.col("start") <= F.col("pos")) & upper).drop("bucket")


def search_items(indexed: DataFrame, terms: Iterable[Term], min_score: float = 0.0, whole_block: bool = False) -> DataFrame:
    """Item results (file_id, block_id, item, content, n, counts, score).

    Scores take the item's own positions and length. With `whole_block` they take all positions and the length of
    the block, as block searches do, and a block below `min_score` gives nothing.
    """
    keys = ("file_id", "block_id", "item")
    if not whole_block:
        found = scan(indexed.select(*keys, "content"), terms, ("text", "n", "search_term_match_counts", "score"), "content", min_score)
        return found.select(*keys, F.col("text").alias("content"), "n", F.col("search_term_match_counts").alias("counts"), "score")
    found = match(indexed.select(*keys, "start", "end", "content"), terms, "content")
    absolute = F.transform("matches", lambda m: F.struct((m["pos"] + F.col("start")).alias("pos"), m["term"].alias("term"), m["order"].alias("order")))
    own = F.when(F.size("matches") > 0, F.struct("item", "content", "matches"))  # collected without nulls
    blocks = found.groupBy("file_id", "block_id").agg(F.max("end").alias("size"), F.flatten(F.collect_list(absolute)).alias("all"), F.collect_list(own).alias("items"))
    blocks = blocks.where(F.size("all") > 0).select("file_id", "block_id", "size", "all", "items", score.clusters(F.col("all")).alias("clusters"))
    blocks = blocks.where(score.advanced(F.col("all"), F.col("size")) >= min_score)
    told = blocks.select("file_id", "block_id", (F.size("all").cast("double") / F.col("size")).alias("share"), "clusters", F.explode("items").alias("x")).select("file_id", "block_id", "share", "clusters", "x.*")
    scored = told.withColumn("score", block_score(F.col("matches"), F.col("share"), F.col("clusters")))
    return scored.where(F.col("score") >= min_score).select(*keys, "content", F.size("matches").cast("long").alias("n"), term_counts(F.col("matches")).alias("counts"), "score")


def search_file(indexed: DataFrame, strings: Iterable[str], exact: bool = False, case_sensitive: bool = False, correct: Callable[[str], str | None] | None = None, min_score: float = 1.0, derivative: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(results, results of the derivative search or None) of a delimited file: every option is honoured.

    The derivative search takes the words of the best word cluster of the first results.
    """
    found = search_items(indexed, prepare(strings, exact, case_sensitive, correct), min_score)
    if not derivative:
        return found, None
    best = word_clusters(top_results(found.withColumn("uri", F.concat_ws(":", "file_id", "block_id", "item"))), ("content",)).first()
    return found, search_items(indexed, [Term(w) for w in best["cluster"].split()] if best else [], min_score)


def fields(found: DataFrame, headers: Iterable[str] = (), text_col: str = "content") -> DataFrame:
    """found with `fields`, (name, value) of the columns of its delimited content; columns without a header are `Column i`."""
    headers = list(headers)
    raw = F.regexp_extract_all(F.concat(F.col(text_col), F.lit(",")), F.lit('("(?:[^"]++|"")*+"|[^,]*+),'), 1)
    value = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    named = F.array(*map(F.lit, headers)) if headers else F.array().cast("array<string>")
    name = lambda i: F.coalesce(F.try_element_at(named, i + 1), F.concat(F.lit("Column "), (i + 1).cast("string")))
    return found.withColumn("fields", F.transform(raw, lambda x, i: F.struct(name(i).alias("name"), value(x).alias("value"))))


def block_score(matches: Column, share: Column, clusters: Column) -> Column:
    """Weights and unique terms of the item; coverage, closeness and distribution of the block, told once for all its items."""
    weights = score.by_order(matches, lambda o: F.lit(score.PENALTY) / (o.cast("double") + 1))
    return weights * F.sqrt(score.unique_terms(matches).cast("double")) * (1 + share) * (1 + 1 / clusters.cast("double")) * (1 + F.least(F.lit(1.0), share))


def total_blocks(size: Column, memory: Column, sub_blocks: Column) -> Column:
    """Blocks that a file of `size` bytes is cut in where each may take memory / sub_blocks."""
    return F.greatest(F.lit(1), F.floor(size / F.greatest(F.floor(memory / sub_blocks), F.lit(1)))) * sub_blocks - 1


def valid_header(header: Column) -> Column:
    """Whether every name is of at most 255 ASCII letters (none at all counts)."""
    return F.forall(header, lambda x: x.rlike("^[A-Za-z]{0,255}$"))
