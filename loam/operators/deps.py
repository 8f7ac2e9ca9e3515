"""Code dependencies: module names, imports, resolution to files, graph report, path similarity, directory clusters."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.components import components
from loam.operators.linkage import UNIT, cut, merges_by_type
from loam.session import discard, written

# Built-in modules, whose imports are no dependencies.
BUILTIN_MODULES = (
    "os", "re", "sys", "typing", "collections", "abc", "asyncio", "dataclasses", "datetime", "enum", "functools", "io", "itertools", "logging", "math",
    "pathlib", "random", "statistics", "string", "time", "warnings", "contextlib", "json", "pickle", "traceback", "urllib", "http", "socket",
)
#: Files of either side that meet at a time where pairs are found.
PAIR_BLOCK = 1024
#: Files beneath a directory that is a place of its own where similarities are told by type.
PLACE_FILES = 16
IMPORTS = "path string, base string, kind string, module string"


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def module_mapping(files: DataFrame) -> DataFrame:
    """(module, path): every dotted prefix of a file's name and, for __init__ files, their directory; the first path wins."""
    parts = F.split(F.regexp_replace(stem(F.col("path")), "/", "."), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    package = F.when(name(F.col("path")) == "__init__.py", F.array(F.regexp_replace(directory(F.col("path")), "/", "."))).otherwise(F.array().cast("array<string>"))
    rows = files.select("path", F.explode(F.array_distinct(F.concat(prefixes, package))).alias("module")).where("module <> ''")
    return rows.groupBy("module").agg(F.min("path").alias("path"))


def found_imports(path: str, source: str | None, builtin: frozenset[str]) -> list[tuple[str, str, str]]:
    """(base, kind, module) of a file's imports, none for a file that does not parse; built-in modules apart."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    folder = path.split("/")[:-1]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name.split(".")[0], "import", a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            base = node.module.split(".")[0]
            if node.level:
                near = folder[: len(folder) - node.level] if len(folder) >= node.level else None
                out.append((base, "from_relative", ".".join([*near, node.module]) if near is not None else node.module))
            else:
                out.append((base, "from_absolute", node.module))
    return [x for x in out if x[0] not in builtin]


def imports(sources: DataFrame, builtin=BUILTIN_MODULES) -> DataFrame:
    """Imports of (path, text) rows; each file is parsed where its row is."""
    builtin = frozenset(builtin)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in found_imports(p, t, builtin)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "base", "kind", "module"])

    return sources.select("path", "text").mapInArrow(task, IMPORTS)


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """found with `target`: by the module mapping, else by candidate paths in order, else by names alike; null if none.

    The last step joins on equal keys (file name, directory name, end of the module), not on a condition over all
    pairs, and takes the first file by path other than the importing one.
    """
    rows = found.distinct().withColumn("id", F.struct("path", "base", "kind", "module"))
    mapped = rows.join(module_mapping(files).select("module", F.col("path").alias("mapped")), "module", "left")
    left = mapped.where("mapped IS NULL")
    inner, here = F.regexp_replace("module", r"\.", "/"), directory(F.col("path"))
    local = F.when(here == "", inner).otherwise(F.concat(here, F.lit("/"), inner))
    ranked = F.when(F.col("kind") == "from_relative", F.array(local, inner)).otherwise(F.array(inner, local))
    both = F.flatten(F.transform(ranked, lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))))
    tried = left.select("id", F.posexplode(both).alias("rank", "candidate")).join(files.select(F.col("path").alias("candidate")), "candidate")
    by_path = tried.groupBy("id").agg(F.min(F.struct("rank", "candidate"))["candidate"].alias("by_path"))
    unknown = left.join(by_path, "id", "left_anti")
    lower = F.lower("module")
    looks = F.array(F.concat(F.lit("f:"), F.lower("base"), F.lit(".py")), F.concat(F.lit("d:"), F.lower("base")))
    ends = F.transform(F.sequence(F.lit(1), F.length(lower)), lambda i: F.concat(F.lit("e:"), F.substring(lower, i, F.length(lower))))
    keyed = unknown.select("id", "path", F.explode(F.concat(looks, ends)).alias("key"))
    file = F.lower(name(F.col("path")))
    offered = files.select(F.col("path").alias("other"), F.explode(F.array(F.concat(F.lit("f:"), file), F.concat(F.lit("d:"), F.lower(name(directory(F.col("path"))))), F.concat(F.lit("e:"), F.replace(file, F.lit(".py"), F.lit(""))))).alias("key")).where("key NOT IN ('d:', 'e:')")
    alike = keyed.join(offered, "key").where("other <> path").groupBy("id").agg(F.min("other").alias("alike"))
    out = mapped.join(by_path, "id", "left").join(alike, "id", "left")
    return out.select("path", "base", "kind", "module", F.coalesce("mapped", "by_path", "alike").alias("target"))


def edges(resolved: DataFrame) -> DataFrame:
    """(source, target) once each, without loops."""
    return resolved.where("target IS NOT NULL AND target <> path").select(F.col("path").alias("source"), "target").distinct()


def stem_of(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def path_similarity(a: Column, b: Column) -> Column:
    """Common leading components over those of the shorter path, 0.3 more in one directory, 0.2 if one name begins or ends with the other; at most 1."""
    x, y = F.split(a, "/"), F.split(b, "/")
    short = F.least(F.size(x), F.size(y))
    common = F.aggregate(F.sequence(F.lit(1), short), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.element_at(x, i) == F.element_at(y, i)), n + 1).otherwise(n))
    p, q = stem_of(a), stem_of(b)
    near = F.when(directory(a) == directory(b), 0.3).otherwise(0.0)
    alike = F.when(p.startswith(q) | q.startswith(p) | p.endswith(q) | q.endswith(p), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), common / short + near + alike)


def prefix_of(parts: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), n), "/")


def needed(n: Column, least: float) -> Column:
    """How many leading components two paths share, of which the shorter has n, that are alike at `least`; but for those of one directory."""
    return F.greatest(F.lit(1), F.ceil((F.lit(least) - 0.2) * n - 1e-9).cast("int"))


def in_blocks(one: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """one joined with other on key, where each key's rows meet in blocks of PAIR_BLOCK by PAIR_BLOCK, so that a key with many is the work of many tasks."""
    count = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias(name))
    blocks = written(count(one, "ones").join(count(other, "others"), key), "blocks")
    tasks = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as adaptive execution would join partitions by their bytes, which are few, not by their pairs

    def dealt(df: DataFrame, own: str, to: str) -> DataFrame:
        own_block, to_block = F.pmod(F.xxhash64(*df.columns), F.col(f"{own}s")).cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"{to}s") - 1))
        return df.join(blocks, key).withColumn(own, own_block).withColumn(to, to_block).drop("ones", "others").repartition(tasks, *key, "one", "other")

    return dealt(one, "one", "other").hint("merge").join(dealt(other, "other", "one"), [*key, "one", "other"])


def similar_pairs(files: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of files at `least` or more, which is above 0.2.

    Two files have at most 0.2 beside the share of the shorter path that they have in common, or are of one directory.
    So they meet under the prefix that `least` - 0.2 of the shorter path needs: a path asks with its own length, and
    answers for each length up to its own. Files of one directory meet there too, or, where that prefix is the whole
    path, in their directory. No two files meet that can't be alike for lack of that prefix. What a pair of that prefix
    and no more has for similarity is told once a file, not once a pair.
    """
    if not 0.2 < least <= 1:
        raise ValueError("least must be above 0.2, which any two files may have, and at most 1")
    rows = files.select("path", directory(F.col("path")).alias("dir"), F.split("path", "/").alias("parts"), stem_of(F.col("path")).alias("stem"))
    rows = rows.withColumn("n", F.size("parts")).withColumn("need", needed(F.col("n"), least))
    alike = lambda p, q: p.startswith(q) | q.startswith(p) | p.endswith(q) | q.endswith(p)
    prefix = lambda c: F.array_join(F.slice("parts", F.lit(1), c), "/")
    after = lambda c: F.try_element_at("parts", c + 1)
    told = lambda near, more: F.round(F.least(F.lit(1.0), F.col("need") / F.col("n") + near + more), 9)
    asks = rows.select(F.col("path").alias("short"), F.col("dir").alias("dir_a"), F.col("stem").alias("stem_a"), F.col("n").alias("size"), prefix(F.col("need")).alias("prefix"), after(F.col("need")).alias("next_a"),
                       *(told(x, y).alias(k) for k, x, y in (("far", 0.0, 0.0), ("far_alike", 0.0, 0.2), ("near", 0.3, 0.0), ("near_alike", 0.3, 0.2))))
    answers = rows.withColumn("size", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("need", needed(F.col("size"), least))
    answers = answers.select(F.col("path").alias("long"), F.col("dir").alias("dir_b"), F.col("stem").alias("stem_b"), "n", "size", prefix(F.col("need")).alias("prefix"), after(F.col("need")).alias("next_b"))
    pair = F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")
    other = "size < n OR short < long"
    value = F.when(F.col("dir_a") == F.col("dir_b"), F.when(alike(F.col("stem_a"), F.col("stem_b")), F.col("near_alike")).otherwise(F.col("near")))
    value = value.otherwise(F.when(alike(F.col("stem_a"), F.col("stem_b")), F.col("far_alike")).otherwise(F.col("far")))
    just = in_blocks(asks, answers, ["size", "prefix"]).where(other).where(~F.coalesce(F.col("next_a") == F.col("next_b"), F.lit(False))).select(*pair, value.alias("similarity"))
    # one component more in common than that prefix, or several
    deeper = lambda df, x, y: df.where(F.col(f"next_{x}").isNotNull()).select(F.col(y), "size", "prefix", F.col(f"next_{x}").alias("next"), *(["n"] if x == "b" else []))
    beyond = in_blocks(deeper(asks, "a", "short"), deeper(answers, "b", "long"), ["size", "prefix", "next"]).where(other).select(*pair).withColumn("similarity", F.round(path_similarity(F.col("a"), F.col("b")), 9))
    # of one directory, but not of one such prefix: one component each, or `a` and `/a` (but '' is the prefix of `/a`)
    here = rows.where("need = n OR (dir = '' AND n = 2)")
    side = lambda x: here.select("dir", F.col("path").alias(x), F.col("n").alias(f"n_{x}"), F.col("need").alias(f"need_{x}"))
    small = in_blocks(side("a"), side("b"), ["dir"]).where("a < b AND (n_a <> n_b AND a <> '' OR n_a = n_b AND need_a = n_a)").select("a", "b").withColumn("similarity", F.round(path_similarity(F.col("a"), F.col("b")), 9))
    return just.unionByName(beyond).unionByName(small).where(F.col("similarity") >= least)


def directory_similarity(files: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(classes, exceptions): the similar pairs of files of one directory, without a row for each.

    classes (dir, files, pairs, similarity): in a directory every pair has the similarity of its depth, so a row with
    counts stands for all of them, where that is `least` or more. exceptions (a, b, similarity): pairs whose names
    begin or end alike, which are more similar than their class, at `least` or more. Names meet on equal prefixes and
    suffixes, so a directory of n files that have nothing in common costs n rows, not n * n.
    """
    rows = files.select("path").distinct().select("path", directory(F.col("path")).alias("dir"), F.size(F.split("path", "/")).alias("depth"), F.regexp_replace(name(F.col("path")), r"(?<=.)\.[^.]*$", "").alias("stem"))
    base = F.least(F.lit(1.0), (F.col("depth") - 1) / F.col("depth") + 0.3)
    n = F.col("files")
    classes = rows.groupBy("dir", "depth").agg(F.count("*").alias("files")).where((n > 1) & (F.round(base, 9) >= least))
    classes = classes.select("dir", "files", (n * (n - 1) / 2).cast("long").alias("pairs"), F.round(base, 9).alias("similarity"))
    lengths = F.sequence(F.lit(0), F.length("stem"))
    affixes = F.array_distinct(F.concat(F.transform(lengths, lambda k: F.substring("stem", F.lit(1), k)), F.transform(lengths, lambda k: F.substring("stem", k + 1, F.length("stem")))))
    asks = rows.select("dir", "depth", F.col("path").alias("x"), F.explode(affixes).alias("stem"))
    alike = asks.join(rows.select("dir", "stem", F.col("path").alias("y")), ["dir", "stem"]).where("x <> y").select("depth", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    raised = F.round(F.least(F.lit(1.0), base + 0.2), 9)
    return classes, alike.where((raised >= least) & (raised > F.round(base, 9))).select("a", "b", raised.alias("similarity"))


def blended(similarity: Column, adjacent: Column, total: Column, weight: float = 0.3) -> Column:
    """Distance: 1 less the weighted mean of path similarity and adjacency over its sum."""
    return 1 - ((1 - weight) * similarity + weight * F.coalesce(F.try_divide(adjacent, total), F.lit(0.0)))


def adjacent_counts(edges_: DataFrame) -> DataFrame:
    return edges_.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("adjacent"))


def adjacent_pairs(edges_: DataFrame, weight: float = 0.3) -> DataFrame:
    """(a, b, distance) of adjacent files."""
    total = edges_.agg(F.count("*").alias("total"))  # one row
    pairs = adjacent_counts(edges_).crossJoin(F.broadcast(total))
    return pairs.select("a", "b", F.round(blended(path_similarity(F.col("a"), F.col("b")), F.col("adjacent"), F.col("total"), weight), 9).alias("distance"))


def blended_pairs(files: DataFrame, edges_: DataFrame, weight: float = 0.3, least: float = 0.7) -> DataFrame:
    """(a, b, distance) of the sparse graph of files: pairs at path similarity `least` or more, and adjacent ones; no matrix of all pairs is made."""
    total = edges_.agg(F.count("*").alias("total"))  # one row
    adjacent = adjacent_counts(edges_)
    pairs = similar_pairs(files, least).select("a", "b").unionByName(adjacent.select("a", "b")).distinct().join(adjacent, ["a", "b"], "left").crossJoin(F.broadcast(total))
    return pairs.select("a", "b", F.round(blended(path_similarity(F.col("a"), F.col("b")), F.coalesce("adjacent", F.lit(0)), F.col("total"), weight), 9).alias("distance"))


def connecting_pairs(files: DataFrame, ok: Callable[[Column], Column]) -> DataFrame:
    """(a, b): pairs of files with ok(path similarity) that connect all that such pairs connect, a few for each file.

    ok tells for every similarity above one for which it tells; it tells for none up to 0.2. Similar files meet under
    a key on two sides, each file of one with each of the other: a key with both sides is a star about its first file,
    not a row a pair. Keys are a directory; a depth and a prefix of those of the shorter path; and with either an
    affix of a name, which is the whole name on one side.
    """
    rows = files.select("path").distinct().select("path", directory(F.col("path")).alias("dir"), F.split("path", "/").alias("parts"), F.regexp_replace(name(F.col("path")), r"(?<=.)\.[^.]*$", "").alias("stem"))
    rows = rows.withColumn("n", F.size("parts"))
    lengths = F.sequence(F.lit(0), F.length("stem"))
    affixes = F.array_distinct(F.concat(F.transform(lengths, lambda k: F.substring("stem", F.lit(1), k)), F.transform(lengths, lambda k: F.substring("stem", k + 1, F.length("stem")))))
    told = F.least(F.lit(1.0), (F.col("n") - 1) / F.col("n") + 0.3), F.least(F.lit(1.0), (F.col("n") - 1) / F.col("n") + 0.3 + 0.2)
    here = rows.select("path", "stem", F.col("n").alias("m"), F.col("dir").alias("place"), F.lit("directory").alias("kind"), F.lit(True).alias("short"), F.lit(True).alias("long"), ok(told[0]).alias("plain"), ok(told[1]).alias("alike"), affixes.alias("affixes"))
    root = rows.where("dir = '' AND n < 3")  # `a` and `/a` are of one directory and of two depths
    root = root.select("path", "stem", F.lit(1).alias("m"), F.lit("").alias("place"), F.lit("root").alias("kind"), (F.col("n") == 1).alias("short"), (F.col("n") == 2).alias("long"), ok(F.lit(0.3)).alias("plain"), ok(F.lit(0.3) + 0.2).alias("alike"), affixes.alias("affixes"))
    cut = lambda more: F.try_element_at(F.filter(F.sequence(F.lit(1), F.col("m")), lambda c: ok(F.least(F.lit(1.0), c / F.col("m") + 0.0 + more))), F.lit(1))
    below = rows.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("least", cut(0.0)).withColumn("least_alike", cut(0.2))
    at = lambda c: F.array_join(F.slice("parts", F.lit(1), F.col(c)), "/")
    far = lambda c, kind, plain: below.where(F.col(c).isNotNull()).select("path", "stem", "m", at(c).alias("place"), F.lit(kind).alias("kind"), (F.col("n") == F.col("m")).alias("short"), F.lit(True).alias("long"), F.lit(plain).alias("plain"), F.lit(not plain).alias("alike"), affixes.alias("affixes"))
    every = here.unionByName(root).unionByName(far("least", "prefix", True)).unionByName(far("least_alike", "alike", False))
    plain = every.where("plain").select("kind", "m", "place", F.lit(0).alias("way"), F.lit("").alias("affix"), "path", F.col("short").alias("one"), F.col("long").alias("other"))
    named = every.where("alike AND NOT plain").select("kind", "m", "place", "path", "stem", "short", "long", F.explode("affixes").alias("affix"))
    whole = F.col("stem") == F.col("affix")
    named = [named.select("kind", "m", "place", F.lit(way).alias("way"), "affix", "path", (whole & F.col(one)).alias("one"), F.col(other).alias("other")) for way, one, other in ((1, "short", "long"), (2, "long", "short"))]
    sides = reduce(DataFrame.unionByName, named, plain).where("one OR other")
    key = ["kind", "m", "place", "way", "affix"]
    stars = sides.groupBy(*key).agg(F.min("path").alias("a"), F.max("path").alias("last"), F.bool_or("one").alias("any_one"), F.bool_or("other").alias("any_other")).where("any_one AND any_other AND a < last").select(*key, "a")
    return sides.join(stars, key).where("path <> a").select("a", F.col("path").alias("b")).distinct()


def blended_clusters(files: DataFrame, edges_: DataFrame, most: float = 0.4, weight: float = 0.3, least: float = 0.7) -> DataFrame:
    """(path, cluster): files connected by blended distances of at most `most`; a cluster is named by its first path: single linkage cut at `most`.

    No pair is made for each two files that are alike: of pairs that are not adjacent, the similarity alone decides
    (and adjacency only brings files nearer), so connecting_pairs stand for them; adjacent pairs are judged one by one.
    """
    if not 0.2 < least <= 1 or not 0 <= weight <= 1:
        raise ValueError("least must be above 0.2, which any two files may have, and at most 1; weight from 0 to 1")
    near = lambda s: (F.round(s, 9) >= least) & (F.round(blended(s, F.lit(0), F.lit(1), weight), 9) <= most)
    adjacent = adjacent_pairs(edges_, weight).where(F.col("distance") <= most).select("a", "b")
    linked = components(connecting_pairs(files, near).unionByName(adjacent)).select(F.col("node").alias("path"), "root")
    return files.select("path").join(linked, "path", "left").select("path", F.coalesce("root", "path").alias("cluster"))


def typed_links(files: DataFrame, edges_: DataFrame, weight: float = 0.3, least: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, between, extra) of merges_by_type: the graph of blended_pairs without a row for each pair.

    A file's place is its deepest directory with PLACE_FILES files beneath, or the root. With its depth, and whether its
    name is empty (which is alike to any), that is its type. Types tell the similarity of all pairs but those that
    share more than their places do (they lie in one small directory of a place, or one is the other's directory), whose
    names are alike, or that are adjacent: those are compared one by one.
    """
    rows = files.select("path").distinct().select("path", directory(F.col("path")).alias("dir"), F.split("path", "/").alias("parts"), stem_of(F.col("path")).alias("stem"))
    rows = written(rows.withColumn("n", F.size("parts")), "files")
    prefix = lambda c: F.array_join(F.slice("parts", F.lit(1), c), "/")
    above = rows.where("n > 1").withColumn("d", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select("path", "d", prefix(F.col("d")).alias("place"))
    large = above.groupBy("d", "place").count().where(F.col("count") >= PLACE_FILES).drop("count")
    placed = above.join(large, ["d", "place"]).groupBy("path").agg(F.max(F.struct("d", "place")).alias("at"))
    rows_ = rows.join(placed, "path", "left").withColumn("d", F.coalesce("at.d", F.lit(0))).withColumn("place", F.coalesce("at.place", F.lit(""))).withColumn("empty", F.col("stem") == "").drop("at")
    placed = written(rows_.withColumn("type", F.concat_ws("|", "d", "n", F.col("empty").cast("string"), "place")), "placed")
    nodes = placed.select(F.col("path").alias("x"), "type")

    types = placed.groupBy("type", "d", "n", "empty", "place").agg(F.slice(F.any_value("parts"), F.lit(1), F.col("d")).alias("parts"))
    side = lambda x: types.select(*(F.col(c).alias(f"{c}_{x}") for c in ("type", "d", "n", "empty", "place", "parts")))
    under = lambda x: prefix_of(F.col(f"parts_{x}"), needed(F.col("size"), least))
    asks = side("a").withColumn("size", F.col("n_a")).where(F.col("d_a") >= needed(F.col("size"), least)).withColumn("prefix", under("a"))
    answers = side("b").withColumn("size", F.explode(F.sequence(F.lit(1), F.col("n_b")))).where(F.col("d_b") >= needed(F.col("size"), least)).withColumn("prefix", under("b"))
    met = asks.join(answers, ["size", "prefix"]).drop("size", "prefix")
    here = side("a").where("n_a = d_a + 1").join(side("b").where("n_b = d_b + 1"), F.col("place_a") == F.col("place_b"))
    m = F.least("d_a", "d_b")
    common = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.try_element_at("parts_a", i) == F.try_element_at("parts_b", i)), k + 1).otherwise(k))).otherwise(0)
    near = F.when(F.expr("n_a = d_a + 1 AND n_b = d_b + 1 AND place_a = place_b"), 0.3).otherwise(0.0)
    similar = F.least(F.lit(1.0), common / F.least("n_a", "n_b") + near + F.when(F.expr("empty_a OR empty_b"), 0.2).otherwise(0.0))
    unit = lambda s, adjacent, total: F.round((1 - F.round(blended(s, adjacent, total, weight), 9)) * UNIT).cast("long")
    told = met.unionByName(here).withColumn("similarity", similar).where(F.round("similarity", 9) >= least)
    between = written(told.select(F.least("type_a", "type_b").alias("t"), F.greatest("type_a", "type_b").alias("u"), unit(F.col("similarity"), F.lit(0), F.lit(1)).alias("s")).where("s > 0").distinct(), "between")

    pair = lambda df: df.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    x, y = F.col("path").alias("x"), F.col("path").alias("y")
    child = placed.withColumn("child", F.element_at("parts", F.col("d") + 1))
    small = child.select("d", "place", "child", x).join(child.select("d", "place", "child", y), ["d", "place", "child"])
    over = above.select(x, "d", "place").join(rows.select(F.col("n").alias("d"), F.col("path").alias("place"), y), ["d", "place"])
    roots = rows.where("dir = '' AND n = 2").select(x).crossJoin(rows.where("n = 1").select(y)) if least <= 0.5 else over.limit(0)
    lengths = F.sequence(F.lit(0), F.length("stem"))
    affixes = F.array_distinct(F.concat(F.transform(lengths, lambda k: F.substring("stem", F.lit(1), k)), F.transform(lengths, lambda k: F.substring("stem", k + 1, F.length("stem")))))
    named = rows.where("stem <> ''")
    short = named.select("path", "stem", F.col("n").alias("size"), prefix(needed(F.col("n"), least)).alias("prefix"))
    long = named.withColumn("size", F.explode(F.sequence(F.lit(1), F.col("n")))).join(named.select(F.col("n").alias("size")).distinct(), "size").select("path", "stem", "size", prefix(needed(F.col("size"), least)).alias("prefix"))
    folder = named.where(needed(F.col("n"), least) >= F.col("n")).select("path", "stem", F.lit(0).alias("size"), F.col("dir").alias("prefix"))
    cut_ = lambda df: df.withColumn("stem", F.explode(affixes)).where("stem <> ''").select("size", "prefix", "stem", y)
    whole = lambda df: df.select("size", "prefix", "stem", x)
    key = ["size", "prefix", "stem"]
    alike = [whole(short).join(cut_(long), key), whole(long).join(cut_(short), key), whole(folder).join(cut_(folder), key)]
    edges_ = written(edges_.select("source", "target"), "edges")
    adjacent = written(adjacent_counts(edges_), "adjacent")
    pairs = reduce(DataFrame.unionByName, [pair(df.select("x", "y")) for df in (small, over, roots, *alike)], adjacent.select("a", "b")).distinct()
    total = edges_.agg(F.count("*").alias("total"))  # one row
    of = lambda c: nodes.select(F.col("x").alias(c), F.col("type").alias(f"type_{c}"))
    judged = pairs.join(adjacent, ["a", "b"], "left").crossJoin(F.broadcast(total)).join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("similarity", path_similarity(F.col("a"), F.col("b")))
    judged = judged.withColumn("near", F.round("similarity", 9) >= least).where("near OR adjacent IS NOT NULL").withColumn("s", unit(F.col("similarity"), F.coalesce("adjacent", F.lit(0)), F.col("total")))
    judged = judged.withColumn("t", F.least("type_a", "type_b")).withColumn("u", F.greatest("type_a", "type_b")).join(between.withColumnRenamed("s", "told"), ["t", "u"], "left")
    extra = written(judged.select("a", "b", (F.col("s") - F.coalesce("told", F.lit(0))).alias("s"), F.expr("NOT near OR type_a IS NULL OR type_b IS NULL").alias("weak")).where("s > 0"), "extra")
    return nodes, between, extra


def average_linkage(files: DataFrame, edges_: DataFrame, weight: float = 0.3, least: float = 0.7) -> DataFrame:
    """(a, b, similarity): the merges of average linkage over the blended similarities of blended_pairs, absent pairs at 0; no row is made for each pair."""
    if not 0.2 < least <= 1 or not 0 <= weight <= 1:
        raise ValueError("least must be above 0.2, which any two files may have, and at most 1; weight from 0 to 1")
    return merges_by_type(*typed_links(files, edges_, weight, least))


def average_clusters(files: DataFrame, edges_: DataFrame, k: int = 8, weight: float = 0.3, least: float = 0.7) -> DataFrame:
    """(path, cluster): the k clusters of average linkage; a cluster is named by its first path."""
    return cut(files.select("path"), average_linkage(files, edges_, weight, least), k)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `number`, their place from 0 in the order of distinct `order`; sorted by ranges, so no task holds all of them."""
    split = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "sorted")
    sizes = split.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    out = written(split.join(F.broadcast(before), "part").select(*rows.columns, (F.col("place") - F.col("first") + F.col("before")).alias("number")), "numbered")
    discard(split)
    return out


def directory_clusters(files: DataFrame, most: int) -> DataFrame:
    """(path, cluster): directories, the two smallest merged until there are `most`; equal sizes by first directory.

    A merged directory has at least the size of the two smallest. So all that are smaller than that merge among
    themselves, two by two in their order, in one round; sizes at least double from round to round. Rounds are tables
    in the shared folder.
    """
    sized = files.groupBy(directory(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))
    now, joined = written(sized, "directories"), []
    left = now.count()
    while left > max(most, 1):
        ranked = numbered(now, "n", "dir")
        two = ranked.where("number < 2").agg(F.sum("n")).first()[0]
        below = ranked.where(F.col("n") < two).count()
        pairs = min(max(below // 2, 1), left - max(most, 1))
        pair = F.when(F.col("number") < 2 * pairs, F.floor(F.col("number") / 2)).otherwise(F.col("number"))
        named = ranked.withColumn("pair", pair)
        group = named.groupBy("pair", F.col("number") < 2 * pairs).agg(F.min("dir").alias("dir"), F.max("dir").alias("other"), F.sum("n").alias("n"))
        merged = written(group, "directories")
        joined.append(merged.where("dir <> other").select(F.col("dir").alias("a"), F.col("other").alias("b")))
        now, left = merged.select("dir", "n"), left - pairs
    dirs = files.select("path", directory(F.col("path")).alias("dir"))
    roots = components(reduce(DataFrame.unionByName, joined)).select(F.col("node").alias("dir"), "root") if joined else sized.select("dir", F.col("dir").alias("root"))
    found = dirs.join(roots, "dir", "left").select("path", F.coalesce("root", "dir").alias("root"))
    order = found.select("root").distinct().select("root", (F.row_number().over(Window.orderBy("root")) - 1).alias("cluster"))  # `most` rows
    return found.join(F.broadcast(order), "root").select("path", "cluster")


def node_size(degree: Column) -> Column:
    return 4 + 8 * F.sqrt(degree + 1)


def label_size(degree: Column) -> Column:
    """Font of a label; 0 (no label) up to ten edges."""
    return F.when(degree > 10, F.least(F.lit(24), 12 + F.floor((degree - 10) / 2))).otherwise(0)
