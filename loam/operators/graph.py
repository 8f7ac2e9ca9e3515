"""Property graph: nodes (uid, type, props), directed edges (source, target, type, props), versions, snapshots, audit.

Mutations are plans over immutable tables: a batch of changes gives new node and edge tables and rows for the history
and audit tables. A commit is atomic because it writes a new version of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = "uid string, type string, props map<string,string>"
EDGES = "source string, target string, type string, props map<string,string>"
#: Relations that a typed link may have.
RELATIONS = ("non_functional", "eval_sequence", "parameter", "hierarchy", "casual")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of `changes` put in their place or added."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def update(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose properties are overlaid by those of `changes` (keys, props); keys that are not there change nothing."""
    new = changes.select(*keys, F.col("props").alias("new"))
    joined = rows.join(new, keys, "left")
    merged = F.map_concat(F.map_filter("props", lambda k, v: ~F.array_contains(F.coalesce(F.map_keys("new"), F.array().cast("array<string>")), k)), F.coalesce("new", F.create_map().cast("map<string,string>")))
    return joined.withColumn("props", merged).drop("new").select(*rows.columns)


def missing(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes to what is not there: the caller's error rows."""
    return changes.join(rows, keys, "left_anti")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, removed edges) without the nodes of `gone` (uid) and every edge at them."""
    left = nodes.join(gone, "uid", "left_anti")
    sources, targets = gone.select(F.col("uid").alias("source")), gone.select(F.col("uid").alias("target"))
    kept = edges.join(sources, "source", "left_anti").join(targets, "target", "left_anti").select(*edges.columns)
    return left, kept, edges.join(kept, ["source", "target"], "left_anti")


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected): new edges whose ends both exist replace or join the others; there is one edge a pair."""
    ok = new.join(nodes.select(F.col("uid").alias("source")), "source", "left_semi").join(nodes.select(F.col("uid").alias("target")), "target", "left_semi").select(*edges.columns)
    return upsert(edges, ok, ["source", "target"]), dangling(nodes, new)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those of `gone` (source, target)."""
    return edges.join(gone.select("source", "target"), ["source", "target"], "left_anti").select(*edges.columns)


def valid_relation(relation: Column) -> Column:
    """Whether a typed link has one of the known relations."""
    return F.coalesce(relation.isin(*RELATIONS), F.lit(False))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that does not exist."""
    known = nodes.select("uid").distinct()
    no_source = edges.join(known.withColumnRenamed("uid", "source"), "source", "left_anti").select(*edges.columns)
    no_target = edges.join(known.withColumnRenamed("uid", "target"), "target", "left_anti").select(*edges.columns)
    return no_source.unionByName(no_target).dropDuplicates(["source", "target"])


def query(rows: DataFrame, where: Column | None = None, **props: str) -> DataFrame:
    """Rows with all the given properties (type counts as one), and the predicate if there is one."""
    for k, v in props.items():
        rows = rows.where(F.col("type") == v if k == "type" else F.col("props")[k] == v)
    return rows if where is None else rows.where(where)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, in_degree, out_degree, degree) of every node."""
    into = edges.groupBy(F.col("target").alias("uid")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("source").alias("uid")).agg(F.count("*").alias("out_degree"))
    both = nodes.select("uid").join(into, "uid", "left").join(out, "uid", "left").fillna(0, ["in_degree", "out_degree"])
    return both.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees over the number of other nodes; 1 where there is no other."""
    total = nodes.agg(F.count("*").alias("total"))  # one row
    d = degrees(nodes, edges).crossJoin(F.broadcast(total))
    share = lambda c: F.when(F.col("total") <= 1, F.lit(1.0)).otherwise(F.col(c) / (F.col("total") - 1))
    return d.select("uid", *(F.round(share(c), 9).alias(c.replace("degree", "centrality")) for c in ("in_degree", "out_degree", "degree")))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text a node and a link, the layout of saved graphs: (kind, key, json)."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("uid").alias("key"), F.to_json(F.struct(F.col("uid").alias("id"), "type", "props")).alias("json"))
    e = edges.select(F.lit("link").alias("kind"), F.concat_ws(">", "source", "target").alias("key"), F.to_json(F.struct("source", "target", "type", "props")).alias("json"))
    return n.unionByName(e)


def from_node_link(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = rows.where("kind = 'node'").select(F.from_json("json", "id string, type string, props map<string,string>").alias("x")).select(F.col("x.id").alias("uid"), "x.type", "x.props")
    e = rows.where("kind = 'link'").select(F.from_json("json", EDGES).alias("x")).select("x.*")
    return n, e


def history(changes: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """changes with `idx`, the number of the version within its key, from 0."""
    return changes.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(ts, tie)).cast("long") - 1)


def latest(changes: DataFrame, key: str, ts: str, tie: str, *data: str) -> DataFrame:
    """The last version of each key; versions combine before they are dealt."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*data), F.struct(ts, tie)).alias("d")).select(key, "d.*")


def at_index(versions: DataFrame, key: str, idx: int) -> DataFrame:
    """Rollback of every key (a node's, or an edge's) to a version of its history; keys without it are left out (see out_of_range)."""
    return versions.where(F.col("idx") == idx)


def out_of_range(versions: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Of the asked rollbacks (keys, idx), those whose key has no history or no such version: the caller's error rows."""
    known = versions.groupBy(*keys).agg(F.count("*").alias("versions"))
    return asked.join(known, keys, "left").where(F.col("versions").isNull() | (F.col("idx") < 0) | (F.col("idx") >= F.col("versions"))).select(*keys, "idx")


def snapshot(rows: DataFrame, version: int, message: str, clock: Column | None = None) -> DataFrame:
    """Rows to append to the snapshot table."""
    return rows.select(F.lit(version).cast("long").alias("version"), F.lit(message).alias("message"), (clock if clock is not None else F.current_timestamp()).alias("taken_at"), *rows.columns)


def rollback(snapshots: DataFrame, version: int) -> DataFrame:
    return snapshots.where(F.col("version") == version).drop("version", "message", "taken_at")


def audit(changes: DataFrame, event: str, key: str, ts: str, **details: Column) -> DataFrame:
    """Rows to append to the audit table: (event, key, ts, details)."""
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return changes.select(F.lit(event).alias("event"), F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"))


def prompt_line(uid: Column, props: Column) -> Column:
    """`KGNODE► uid : k="v", ...` with keys in order."""
    pairs = F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.concat(F.lit("KGNODE► "), uid, F.lit(" : "), F.array_join(pairs, ", "))


def prompt_text(nodes: DataFrame) -> DataFrame:
    """One text of a selection of nodes that a prompt holds: a `KG►` header, then a line a node by uid. A prompt is small; select before."""
    lines = nodes.agg(F.array_sort(F.collect_list(F.struct("uid", prompt_line(F.col("uid"), F.col("props")).alias("line")))).alias("all"))
    return lines.select(F.concat_ws("\n", F.lit("KG►"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("prompt"))


def valid_weight(weight: Column) -> Column:
    """Whether an initial weight is from -1 to 1."""
    return F.coalesce(weight.between(-1.0, 1.0), F.lit(False))


def outcome_weight(result: Column, target: Column) -> Column:
    """1 where the result is the target state (null equals null), else -1."""
    return F.when(result.eqNullSafe(target), 1.0).otherwise(-1.0)
