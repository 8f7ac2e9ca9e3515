"""Registered queries over items, graphs, versions and small tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import graph as G
from loam.operators import items as I
from loam.operators import results as R
from loam.operators import tabular as U
from loam.operators import terms as Q
from loam.operators.terms import Term
from loam.plans.search import ADVANCED, SCORE_CTE, table, text_cte
from loam.session import folder
from loam.sources import files, ranges, tables
from loam.streaming import versions as V

#: Keys of a block of delimited customers.
PER_BLOCK = 500
ITEM_TERMS = (Term("BUILDING", 0), Term("Customer", 1), Term("12", 1), Term("AUTO", 2))
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def customers(spark, sf):
    return I.index(I.delimited(table(spark, sf, "customer"), CUSTOMER, "c_custkey", "customer", PER_BLOCK))


def item_index(spark, sf):
    return I.numbered(customers(spark, sf)).select("block_id", "item", "start", F.col("end").alias("stop"), "global_item", "content")


def item_offsets(spark, sf):
    return I.offsets(customers(spark, sf)).select("block_id", "n", "item_offset")


def item_positions(spark, sf):
    """A position for each order: its key within the block of its customer."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.lit("customer").alias("file_id"), F.floor(F.col("o_custkey") / PER_BLOCK).cast("long").alias("block_id"), F.pmod(F.col("o_orderkey"), F.lit(20000)).alias("pos"))


def position_to_item(inclusive):
    def query(spark, sf):
        return I.positions_to_items(item_positions(spark, sf), customers(spark, sf), inclusive).select("o_orderkey", "block_id", "pos", "item")

    return query


def item_search(spark, sf):
    found = I.search_items(customers(spark, sf), ITEM_TERMS, 0.0)
    return found.select("block_id", "item", "content", "n", F.round("score", 6).alias("score"))


def item_search_block(spark, sf):
    found = I.search_items(customers(spark, sf), ITEM_TERMS, 1.0, whole_block=True)
    return found.select("block_id", "item", "n", F.round("score", 6).alias("score"))


#: An item begins with digits and the name of a customer.
BEGIN = r"\d+,Customer"


def broken(c=F.col):
    """Every third item holds raw breaks and text that looks like a row."""
    return F.concat_ws(",", c("c_custkey").cast("string"), c("c_name"), F.when(c("c_custkey") % 3 == 0, F.lit("a\r\n\r\n12,b")).otherwise(F.lit("a")), c("c_mktsegment"))


def item_index_validated(spark, sf):
    """Blocks as whole texts, cut at breaks that a valid start follows; each block ends in an empty item."""
    c = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / PER_BLOCK).cast("long").alias("block_id"), F.struct("c_custkey", broken().alias("item")).alias("x"))
    blocks = c.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]), I.BREAK).alias("text"))
    return I.split_block(blocks.select(F.lit("customer").alias("file_id"), "block_id", F.concat("text", F.lit(I.BREAK)).alias("text")), begin=BEGIN).select("block_id", "item", "start", F.col("end").alias("stop"), F.length("content").alias("size"))


def delimited_file(spark, sf):
    """A delimited file of customers with a header and raw breaks."""
    at = folder(spark, "delimited")
    rows = table(spark, sf, "customer").select("c_custkey", broken().alias("value")).unionByName(spark.createDataFrame([(-1, "key,name,told,segment")], "c_custkey long, value string"))
    rows.coalesce(1).sortWithinPartitions("c_custkey").select("value").write.mode("append").option("lineSep", I.BREAK).text(at)
    return at


def item_index_file(spark, sf):
    """The file, read in parallel and cut at valid starts."""
    at = delimited_file(spark, sf)
    found = files.item_index(spark, at, BEGIN, header=True)
    return found.select("item", "start", F.col("end").alias("stop"), F.regexp_extract("content", r"^(\d+),", 1).cast("long").alias("c_custkey"), F.length("content").alias("size"))


def line_starts(spark, sf):
    """How many lines the documents have, where the last begins, and the sum of all starts."""
    found = files.line_starts(table(spark, sf, "documents").select("doc_id", "text"))
    total = F.aggregate("line_starts", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.where("text IS NOT NULL").select("doc_id", F.size("line_starts").cast("long").alias("n"), F.element_at("line_starts", -1).cast("long").alias("last"), total.alias("total"))


def entries_first(spark, sf):
    """The first 256 pages by path, as a listing shows them."""
    return files.entries(page_files(spark, sf))


def item_range_read(spark, sf):
    """The items of the second quarter of the file, of which alone the bytes are read, by stored offsets."""
    n, at = table(spark, sf, "customer").count(), folder(spark, "offsets")
    ranges.store_offsets(spark, delimited_file(spark, sf), at, BEGIN, header=True)
    return ranges.items_between(spark, at, n // 4 + 1, n // 2).select("item", F.length("content").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


def item_index_stored(spark, sf):
    """Customers indexed once into tables; the search reads the stored index."""
    at = folder(spark, "index")
    tables.store_index(customers(spark, sf), at)
    stored, _ = tables.load_index(spark, at)
    found = I.search_items(customers(spark, sf), ITEM_TERMS, 0.0).select("file_id", "block_id", "item", "n", F.round("score", 6).alias("score"))
    return found.join(stored, ["file_id", "block_id", "item"]).select("global_item", "start", F.col("end").alias("stop"), "n", "score")


def item_offsets_stored(spark, sf):
    at = folder(spark, "index")
    tables.store_index(customers(spark, sf), at)
    return tables.load_index(spark, at)[1].select("block_id", "item_offset")


FACADE = ("Buildinh", "customer")


def search_facade(spark, sf):
    found, _ = I.search_file(customers(spark, sf), FACADE, correct={"Buildinh": "Building"}.get, min_score=2.0)
    return found.select("block_id", "item", "n", F.round("score", 6).alias("score"))


def item_fields(spark, sf):
    found = I.search_items(customers(spark, sf), ITEM_TERMS, 0.0).select("block_id", "item", "content")
    rows = I.fields(found, ["key", "name"]).select("block_id", "item", F.posexplode("fields").alias("place", "f"))
    return rows.select("block_id", "item", F.col("place").cast("long"), "f.name", "f.value")


def item_fields_quoted(spark, sf):
    """Items that hold whole texts as quoted fields, with line ends, quotes and commas inside."""
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = table(spark, sf, "documents").select("doc_id", F.concat_ws(",", F.col("doc_id").cast("string"), quoted, F.coalesce("lang", F.lit(""))).alias("content"))
    return I.fields(rows, ["key", "text"]).select("doc_id", F.posexplode("fields").alias("place", "f")).select("doc_id", F.col("place").cast("long"), "f.name", "f.value")


def merge_results(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("uri"), F.col("l_partkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("term"), F.lit(1).cast("long").alias("n"), F.col("l_quantity").alias("score"), F.col("l_linestatus").alias("content"))
    return R.merge(l).select("uri", "item", "n", "score", "content", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


def block_count(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", I.total_blocks(F.col("p_partkey") * 1048576, F.lit(67108864), F.lit(4)).cast("long").alias("blocks"))


def header_valid(spark, sf):
    c = table(spark, sf, "customer")
    h = F.array("c_mktsegment", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).otherwise(F.lit("")))
    return c.select("c_custkey", I.valid_header(h).alias("ok"))


def nodes(spark, sf):
    def one(source, mark, key, kind, **props):
        pairs = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
        return table(spark, sf, source).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("uid"), F.lit(kind).alias("type"), F.create_map(*pairs).alias("props"))

    parts = [one("region", "R:", "r_regionkey", "region", name="r_name"), one("nation", "N:", "n_nationkey", "nation", name="n_name"), one("customer", "C:", "c_custkey", "customer", name="c_name", segment="c_mktsegment"), one("supplier", "S:", "s_suppkey", "supplier", name="s_name")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark, sf):
    def one(name, a, ka, b, kb, kind):
        return table(spark, sf, name).select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("source"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("target"), F.lit(kind).alias("type"), F.create_map(F.lit("relation"), F.lit("hierarchy")).alias("props"))

    return one("nation", "N:", "n_nationkey", "R:", "n_regionkey", "in_region").unionByName(one("customer", "C:", "c_custkey", "N:", "c_nationkey", "lives_in")).unionByName(one("supplier", "S:", "s_suppkey", "N:", "s_nationkey", "sits_in"))


def told(rows):
    return rows.withColumn("props", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))


def graph_upsert(spark, sf):
    new = table(spark, sf, "supplier").select(F.concat(F.lit("C:"), F.col("s_suppkey").cast("string")).alias("uid"), F.lit("customer").alias("type"), F.create_map(F.lit("name"), F.col("s_name")).alias("props"))
    return told(G.upsert(nodes(spark, sf), new, ["uid"]))


def graph_update(spark, sf):
    change = table(spark, sf, "orders").groupBy(F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("uid")).agg(F.count("*").alias("n"))
    change = change.select("uid", F.create_map(F.lit("orders"), F.col("n").cast("string"), F.lit("segment"), F.lit("has orders")).alias("props"))
    return told(G.update(nodes(spark, sf), change, ["uid"]))


def gone(spark):
    return spark.createDataFrame([("N:3",), ("C:7",), ("X:1",)], "uid string")


def graph_remove(part):
    def query(spark, sf):
        found = G.remove_nodes(nodes(spark, sf), edges(spark, sf), gone(spark))[part]
        return found.select("uid", "type") if part == 0 else found.select("source", "target", "type")

    return query


def more_edges(spark, sf):
    o = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    return o.select(F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("C:"), F.col("l_orderkey").cast("string")).alias("target"), F.lit("ships_to").alias("type"), F.create_map().cast("map<string,string>").alias("props"))


def edge_changes(spark, sf):
    """Every second customer's edge gets a note; one edge that isn't there."""
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("target"), F.create_map(F.lit("note"), F.col("c_mktsegment")).alias("props"))
    return c.unionByName(spark.createDataFrame([("C:0", "N:0", {"note": "none"})], "source string, target string, props map<string,string>"))


def edge_versions(spark, sf):
    """Versions of supplier-part edges: their line items in order."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_quantity")
    return l.withColumn("idx", F.row_number().over(Window.partitionBy("source", "target").orderBy("at")).cast("long") - 1)


def out_of_range(spark, sf):
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") * 2).alias("target"), F.pmod("s_suppkey", F.lit(4)).cast("long").alias("idx"))
    return G.out_of_range(edge_versions(spark, sf), asked, ["source", "target"])


def graph_saved(spark, sf):
    """Nodes and a snapshot, saved and loaded."""
    at = folder(spark, "graph")
    n = nodes(spark, sf)
    tables.save_graph(n, edges(spark, sf), G.snapshot(n.where("type = 'nation'").select("uid", "type"), 3, "nations", F.lit("2024-01-01T00:00:00")), at)
    _, e, snaps = tables.load_graph(spark, at)
    return e.where("type = 'in_region'").select("source", "target").unionByName(G.rollback(snaps, 3).select(F.col("uid").alias("source"), F.col("type").alias("target")))


def page_files(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf, "pages").select(F.concat_ws("/", path, F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("path"), F.octet_length("html").cast("long").alias("length"))


def source_files(spark, sf):
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.pmod("p_partkey", F.lit(len(FOLDERS))) + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod("p_size", F.lit(len(NAMES))) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat(folder, F.col("p_partkey").cast("string"), name).alias("path"))


FOLDERS = ("src/m", "build/m", "lib/python3.9/m", "pkg/.hidden/m", "my_venv/m", "tests/test_", "opt/m", "x/opt/m")
NAMES = (".py", ".pyc", "_test.py", ".toml", "/Makefile", "/__init__.py", ".R", ".exe")


def events(spark, sf):
    return table(spark, sf, "events").withColumn("data", F.to_json(F.struct("event_type", F.round("value", 4).alias("value"))))


def state_as_of(spark, sf):
    """The last event of each user before a point in time."""
    e = table(spark, sf, "events").where("ts < timestamp_ntz'2024-01-15 00:00:00'")
    return G.latest(e, "user_id", "ts", "event_id", "event_type", "value").select("user_id", "event_type", "value")


def versions_streamed(spark, sf):
    """Events of users that arrive in three parts, each kept by a run of its own; every seventh goes back to the user's first version."""
    at = folder(spark, "versions")
    back = F.when(F.col("event_id") % 7 == 0, F.lit(0).cast("long"))
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("tie"), back.alias("back"), F.col("event_type").alias("data"))
    first, second = F.expr("timestamp_ntz'2024-01-10 00:00:00'"), F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    for part in (F.col("ts") < first, (F.col("ts") >= first) & (F.col("ts") < second), F.col("ts") >= second):
        e.where(part).write.mode("append").parquet(f"{at}/in")
        V.keep(spark.readStream.schema(e.schema).parquet(f"{at}/in"), f"{at}/kept", f"{at}/checkpoint").awaitTermination()
    found = V.history(V.all_versions(spark, f"{at}/kept"))
    return found.select("key", "idx", "data", "error")


def snapshots(spark, sf):
    clock = F.lit("2024-01-01T00:00:00")
    n = nodes(spark, sf).select("uid", "type")
    first, second = G.snapshot(n, 1, "first", clock), G.snapshot(n.where("type <> 'customer'"), 2, "no customers", clock)
    return G.rollback(first.unionByName(second), 2)


def snapshot_list(spark, sf):
    clock = F.lit("2024-01-01T00:00:00")
    n = nodes(spark, sf).select("uid", "type")
    both = G.snapshot(n, 1, "first", clock).unionByName(G.snapshot(n.where("type <> 'customer'"), 2, "no customers", clock))
    return both.groupBy("version", "message").agg(F.count("*").alias("n"))


def audit_log(spark, sf):
    rows = G.audit(table(spark, sf, "events"), "update_node", "user_id", "ts", kind=F.col("event_type"), id=F.col("event_id"))
    return rows.groupBy("event", "key", F.col("details")["kind"].alias("kind")).agg(F.count("*").alias("n"), F.max(F.col("details")["id"].cast("long")).alias("last"))


def most_dependent(direction):
    def query(spark, sf):
        d = G.degrees(nodes(spark, sf), edges(spark, sf))
        return d.select("uid", direction).orderBy(F.desc(direction), "uid").limit(10)

    return query


def serialized(spark, sf):
    return nodes(spark, sf).select("uid", G.prompt_line(F.col("uid"), F.col("props")).alias("line"))


def outcome_weights(spark, sf):
    return table(spark, sf, "labels").select("doc_id", G.outcome_weight(F.col("quality"), 1 - F.col("toxic")).alias("weight"))


def property_filter(spark, sf):
    """Equality filter over JSON documents."""
    e = table(spark, sf, "events")
    return e.where((F.get_json_object("props", "$.k") == "7") & (F.col("event_type") == "click")).select("event_id", "user_id")


QUERIES = {
    "item_index_validated": item_index_validated, "item_index_file": item_index_file, "item_range_read": item_range_read, "line_starts": line_starts, "entries_first": entries_first, "item_index_stored": item_index_stored, "item_offsets_stored": item_offsets_stored,
    "search_facade": search_facade, "item_fields": item_fields, "item_fields_quoted": item_fields_quoted,
    "graph_update_edge": lambda s, d: told(G.update(edges(s, d), edge_changes(s, d), ["source", "target"])),
    "graph_remove_edge": lambda s, d: G.remove_edges(edges(s, d), edge_changes(s, d)).select("source", "target", "type"),
    "graph_missing_edge": lambda s, d: G.missing(edges(s, d), edge_changes(s, d), ["source", "target"]).select("source", "target"),
    "rollback_edge": lambda s, d: G.at_index(edge_versions(s, d), "source", 1).select("source", "target", "at", "l_quantity"), "rollback_out_of_range": out_of_range,
    "graph_saved": graph_saved, "graph_prompt_text": lambda s, d: G.prompt_text(nodes(s, d).where("type IN ('region', 'nation')")),
    "relation_check": lambda s, d: table(s, d, "events").select("event_id", G.valid_relation(F.when(F.col("event_id") % 3 == 0, F.lit("hierarchy")).when(F.col("event_id") % 3 == 1, F.col("event_type"))).alias("ok")),
    "weight_check": lambda s, d: table(s, d, "customer").select("c_custkey", G.valid_weight(F.col("c_acctbal") / 5000).alias("ok")),
    "file_tree": lambda s, d: files.tree(page_files(s, d)), "file_tree_reload": lambda s, d: files.from_tree_json(files.tree_json(files.tree(page_files(s, d)))),
    "file_filter_default": lambda s, d: source_files(s, d).where(U.valid_file(F.col("path"))).select("p_partkey"), "suffix_default": lambda s, d: source_files(s, d).select("p_partkey", U.supported(F.col("path")).alias("ok")),
    "quant_types": lambda s, d: table(s, d, "part").select("p_partkey", U.valid_quant(F.concat(F.lit("Q"), F.pmod("p_partkey", F.lit(9)).cast("string"), F.when(F.col("p_size") % 3 == 0, "_0").when(F.col("p_size") % 3 == 1, "_K").otherwise("_K_M"))).alias("ok")),
    "chat_filled": lambda s, d: U.chat_filled(table(s, d, "conversations")).withColumn("children", F.array_join("children", ",")),
    "item_index": item_index, "item_offsets": item_offsets, "position_to_item_inclusive": position_to_item(True), "position_to_item_halfopen": position_to_item(False),
    "item_search": item_search, "item_search_block": item_search_block, "merge_results": merge_results, "block_count": block_count, "header_valid": header_valid,
    "graph_nodes": lambda s, d: told(nodes(s, d)), "graph_edges": lambda s, d: told(edges(s, d)), "graph_upsert_node": graph_upsert, "graph_update_node": graph_update,
    "graph_remove_node": graph_remove(0), "graph_remove_node_edges": graph_remove(1), "graph_removed_edges": graph_remove(2),
    "graph_add_edges": lambda s, d: G.add_edges(nodes(s, d), edges(s, d), more_edges(s, d))[0].select("source", "target", "type"),
    "graph_dangling_edges": lambda s, d: G.dangling(nodes(s, d), more_edges(s, d)).select("source", "target"),
    "graph_query_nodes": lambda s, d: told(G.query(nodes(s, d), F.col("uid") > "C:5", type="customer", segment="BUILDING")),
    "graph_query_edges": lambda s, d: told(G.query(edges(s, d), None, type="lives_in")),
    "graph_get_node": lambda s, d: told(G.query(nodes(s, d), F.col("uid") == "C:42")), "graph_stats": lambda s, d: G.stats(nodes(s, d), edges(s, d)),
    "degrees": lambda s, d: G.degrees(nodes(s, d), edges(s, d)), "degree_centrality": lambda s, d: G.centrality(nodes(s, d), edges(s, d)),
    "most_dependent_top10": most_dependent("in_degree"), "most_dependencies_top10": most_dependent("out_degree"), "node_link_json": lambda s, d: G.node_link(nodes(s, d), edges(s, d)),
    "graph_reload": lambda s, d: told(G.from_node_link(G.node_link(nodes(s, d), edges(s, d)))[0]), "graph_prompt": serialized,
    "version_history": lambda s, d: G.history(events(s, d), "user_id", "ts", "event_id").select("user_id", "idx", "event_id"),
    "rollback_node": lambda s, d: G.at_index(G.history(events(s, d), "user_id", "ts", "event_id"), "user_id", 2).select("user_id", "event_id", "event_type"),
    "state_as_of": state_as_of, "versions_streamed": versions_streamed, "snapshots": snapshots, "snapshot_list": snapshot_list, "audit_log": audit_log, "outcome_weights": outcome_weights, "property_filter": property_filter,
    "success_rate": lambda s, d: U.success_rate(table(s, d, "labels"), F.col("quality") == 1), "success_rate_empty": lambda s, d: U.success_rate(table(s, d, "labels").where("false"), F.col("quality") == 1),
    "format_size": lambda s, d: table(s, d, "part").select("p_partkey", T.size_text((F.col("p_partkey") * F.col("p_partkey") * F.col("p_partkey")).cast("long")).alias("size")),
    "duration_text": lambda s, d: table(s, d, "orders").select("o_orderkey", T.duration_text(F.col("o_orderkey") * 37).alias("took")),
    "size_percent": lambda s, d: U.size_percent(table(s, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") * 1000000).alias("size"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size").cast("long") * 100000000).alias("base"))),
    "keep_last_dedup": lambda s, d: U.keep_last(table(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id"),
    "benchmark_rows": lambda s, d: U.benchmark_rows(table(s, d, "part").select(F.col("p_name").alias("path"), F.element_at(F.split("p_type", " "), 1).alias("type"), F.col("p_size").alias("size"), F.concat(F.col("p_partkey").cast("string"), F.lit("%")).alias("percent"), (F.col("p_size") % 10 == 0).alias("failed"))),
    "chat_links": lambda s, d: U.chat_links(table(s, d, "conversations")), "chat_current": lambda s, d: U.chat_current(table(s, d, "conversations")),
    "file_categories": lambda s, d: table(s, d, "documents").select("doc_id", U.category(F.octet_length(F.coalesce("text", F.lit(""))), 4096).alias("category")),
    "file_filter": lambda s, d: table(s, d, "pages").where(U.valid_file(F.col("url"), [r"/en/", r"page="], [r"^http:"])).select("page_id"),
    "suffix_supported": lambda s, d: table(s, d, "pages").select("page_id", U.supported(F.regexp_replace("url", r"[#?].*", ""), (".txt", ".md", "1", "7")).alias("ok")),
    "distance": lambda s, d: table(s, d, "supplier").select("s_suppkey", F.round(U.distance(F.col("s_acctbal"), F.lit(0.0), F.col("s_nationkey"), F.lit(3)), 6).alias("d")),
    "throughput": lambda s, d: U.throughput(table(s, d, "documents").select(F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes")), 2.0),
    "cache_todo": lambda s, d: U.todo(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id"), ["doc_id"]),
    "cache_lookup": lambda s, d: U.lookup(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id", "quality"), ["doc_id"]).fillna(-1, ["quality"]),
}

BLOCKS = f"""it AS (SELECT c_custkey // {PER_BLOCK} AS block_id, c_custkey AS seq, concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment) AS content FROM customer),
ix AS (SELECT block_id, row_number() OVER w AS item, CAST(sum(length(content) + 2) OVER w AS BIGINT) AS stop, CAST(sum(length(content) + 2) OVER w AS BIGINT) - length(content) - 2 AS start, content FROM it WINDOW w AS (PARTITION BY block_id ORDER BY seq)),
ct AS (SELECT block_id, count(*) AS n FROM ix GROUP BY 1), off AS (SELECT block_id, n, CAST(coalesce(sum(n) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS item_offset FROM ct)"""
NODES = """nd AS (SELECT 'R:' || r_regionkey AS uid, 'region' AS type, 'name=' || r_name AS props FROM region UNION ALL SELECT 'N:' || n_nationkey, 'nation', 'name=' || n_name FROM nation
UNION ALL SELECT 'C:' || c_custkey, 'customer', 'name=' || c_name || ';segment=' || c_mktsegment FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'supplier', 'name=' || s_name FROM supplier)"""
EDGES = """ed AS (SELECT 'N:' || n_nationkey AS source, 'R:' || n_regionkey AS target, 'in_region' AS type, 'relation=hierarchy' AS props FROM nation UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'lives_in', 'relation=hierarchy' FROM customer
UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'sits_in', 'relation=hierarchy' FROM supplier)"""
MORE = "mo AS (SELECT DISTINCT 'S:' || l_suppkey AS source, 'C:' || l_orderkey AS target FROM lineitem)"
DEGREES = f"WITH {NODES}, {EDGES}, dg AS (SELECT uid, (SELECT count(*) FROM ed WHERE target = uid) AS in_degree, (SELECT count(*) FROM ed WHERE source = uid) AS out_degree FROM nd)"
POSITIONS = f"po AS (SELECT o_orderkey, o_custkey // {PER_BLOCK} AS block_id, o_orderkey % 20000 AS pos FROM orders)"
ITEM_SOURCE = "SELECT {'b': block_id, 'i': item} AS doc_id, content AS text FROM ix"
HISTORY = "WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
SIZE = lambda x: f"CASE WHEN {x} < 1024 THEN {x} || ' B' WHEN {x} < 1048576 THEN printf('%.2f KB', {x} / 1024.0::DOUBLE) WHEN {x} < 1073741824 THEN printf('%.2f MB', {x} / 1048576.0::DOUBLE) ELSE printf('%.2f GB', {x} / 1073741824.0::DOUBLE) END"

TOLD = """concat_ws(',', c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'a' || chr(13) || chr(10) || chr(13) || chr(10) || '12,b' ELSE 'a' END, c_mktsegment)"""
#: Ancestors of each page's file, its own directory with its size.
TREE = """fi AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/' || page_id || '.html' AS path, CAST(strlen(html) AS BIGINT) AS size FROM pages),
an AS (SELECT path, size, string_split(path, '/') AS ps, unnest(range(0, len(string_split(path, '/')))) AS k FROM fi),
nd AS (SELECT array_to_string(ps[1:k], '/') AS path, k, CAST(sum(CASE WHEN k = len(ps) - 1 THEN size ELSE 0 END) AS BIGINT) AS size FROM an GROUP BY ALL),
tr AS (SELECT path, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent, size, true AS directory FROM nd UNION ALL SELECT path, regexp_replace(path, '/[^/]*$', ''), size, false FROM fi)"""
SOURCES = f"sf AS (SELECT p_partkey, list_extract({list(FOLDERS)}, p_partkey % {len(FOLDERS)} + 1) || p_partkey || list_extract({list(NAMES)}, p_size % {len(NAMES)} + 1) AS path FROM part)"
EXCLUDED, INCLUDED = "|".join(U.SOURCE_EXCLUDES + U.OTHER_EXCLUDES), "|".join(U.SOURCE_INCLUDES)
EDGE_VERSIONS = """ev AS (SELECT l_suppkey AS source, l_partkey AS target, l_orderkey * 10 + l_linenumber AS "at", l_quantity, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS idx FROM lineitem)"""
EVEN = "ch AS (SELECT 'C:' || c_custkey AS source, 'N:' || c_nationkey AS target, c_mktsegment AS note FROM customer WHERE c_custkey % 2 = 0)"
FACADE_TERMS = Q.last_wins(Q.prepare(FACADE, False, correct={"Buildinh": "Building"}.get))

ORACLES = {
    "item_index_validated": f"""WITH x AS (SELECT c_custkey // {PER_BLOCK} AS block_id, c_custkey, {TOLD} AS t FROM customer)
        SELECT block_id, row_number() OVER w AS item, CAST(sum(length(t) + 2) OVER w AS BIGINT) - length(t) - 2 AS start, CAST(sum(length(t) + 2) OVER w AS BIGINT) AS stop, length(t) AS size FROM x WINDOW w AS (PARTITION BY block_id ORDER BY c_custkey)""",
    "item_index_file": f"""WITH x AS (SELECT c_custkey, {TOLD} AS t FROM customer)
        SELECT row_number() OVER w AS item, 23 + CAST(sum(length(t) + 2) OVER w AS BIGINT) - length(t) - 2 AS start, 23 + CAST(sum(length(t) + 2) OVER w AS BIGINT) AS stop, c_custkey, length(t) AS size FROM x WINDOW w AS (ORDER BY c_custkey)""",
    "line_starts": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start FROM l)
        SELECT doc_id, count(*) AS n, CAST(max(start) AS BIGINT) AS last, CAST(sum(start) AS BIGINT) AS total FROM s GROUP BY doc_id""",
    "entries_first": """WITH f AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/' || page_id || '.html' AS path, page_id || '.html' AS name, octet_length(encode(html)) AS n FROM pages ORDER BY path LIMIT 256)
        SELECT name, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', round(n / 1024.0::DOUBLE, 2)) ELSE printf('%.2f MB', round(n / 1048576.0::DOUBLE, 2)) END AS size FROM f""",
    "item_range_read": f"""WITH x AS (SELECT {TOLD} AS t, row_number() OVER (ORDER BY c_custkey) AS item, count(*) OVER () AS n FROM customer)
        SELECT item, length(t) AS size, sha256(t) AS digest FROM x WHERE item BETWEEN n // 4 + 1 AND n // 2""",
    "item_index_stored": f"WITH {BLOCKS}, {text_cte(ITEM_TERMS, ITEM_SOURCE)}, {SCORE_CTE} SELECT item_offset + ix.item AS global_item, ix.start, ix.stop, s.n, round({ADVANCED.replace('n AS', 's.n AS')}, 6) AS score FROM s JOIN ix ON ix.block_id = doc_id.b AND ix.item = doc_id.i JOIN off ON off.block_id = ix.block_id",
    "item_offsets_stored": f"WITH {BLOCKS} SELECT block_id, item_offset FROM off",
    "search_facade": f"WITH {BLOCKS}, {text_cte(FACADE_TERMS, ITEM_SOURCE)}, {SCORE_CTE} SELECT doc_id.b AS block_id, doc_id.i AS item, n, round({ADVANCED}, 6) AS score FROM s WHERE {ADVANCED} >= 2",
    "item_fields": f"""WITH {BLOCKS}, {text_cte(ITEM_TERMS, ITEM_SOURCE)}, f AS (SELECT doc_id.b AS block_id, doc_id.i AS item, string_split(text, ',') AS vs FROM d WHERE doc_id IN (SELECT doc_id FROM m))
        SELECT block_id, item, i - 1 AS place, CASE i WHEN 1 THEN 'key' WHEN 2 THEN 'name' ELSE 'Column ' || i END AS name, vs[i] AS value FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM f)""",
    "item_fields_quoted": """SELECT doc_id, i - 1 AS place, ['key', 'text', 'Column 3'][i] AS name, [CAST(doc_id AS VARCHAR), coalesce(text, ''), coalesce(lang, '')][i] AS value
        FROM (SELECT *, unnest([1, 2, 3]) AS i FROM documents)""",
    "graph_update_edge": f"WITH {EDGES}, {EVEN} SELECT source, target, type, CASE WHEN note IS NULL THEN props ELSE 'note=' || note || ';' || props END AS props FROM ed LEFT JOIN ch USING (source, target)",
    "graph_remove_edge": f"WITH {EDGES}, {EVEN} SELECT source, target, type FROM ed WHERE (source, target) NOT IN (SELECT source, target FROM ch)",
    "graph_missing_edge": "SELECT 'C:0' AS source, 'N:0' AS target",
    "rollback_edge": f'WITH {EDGE_VERSIONS} SELECT source, target, "at", l_quantity FROM ev WHERE idx = 1',
    "rollback_out_of_range": f"WITH {EDGE_VERSIONS}, a AS (SELECT s_suppkey AS source, s_suppkey * 2 AS target, s_suppkey % 4 AS idx FROM supplier) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.source = a.source AND ev.target = a.target AND ev.idx = a.idx)",
    "graph_saved": "SELECT 'N:' || n_nationkey AS source, 'R:' || n_regionkey AS target FROM nation UNION ALL SELECT 'N:' || n_nationkey, 'nation' FROM nation",
    "graph_prompt_text": f"""WITH {NODES} SELECT 'KG►' || chr(10) || string_agg('KGNODE► ' || uid || ' : name="' || substr(props, 6) || '"', chr(10) ORDER BY uid) AS prompt FROM nd WHERE type IN ('region', 'nation')""",
    "relation_check": "SELECT event_id, event_id % 3 = 0 AS ok FROM events", "weight_check": "SELECT c_custkey, coalesce(c_acctbal / 5000 BETWEEN -1 AND 1, false) AS ok FROM customer",
    "file_tree": f"WITH {TREE} SELECT * FROM tr", "file_tree_reload": f"WITH {TREE} SELECT * FROM tr",
    "file_filter_default": f"WITH {SOURCES} SELECT p_partkey FROM sf WHERE NOT regexp_matches(path, '{EXCLUDED}') AND regexp_matches(path, '{INCLUDED}')",
    "suffix_default": f"WITH {SOURCES} SELECT p_partkey, len(list_filter({list(U.TEXT_SUFFIXES)}, lambda x: ends_with(path, x))) > 0 AS ok FROM sf",
    "quant_types": f"SELECT p_partkey, 'Q' || p_partkey % 9 || CASE p_size % 3 WHEN 0 THEN '_0' WHEN 1 THEN '_K' ELSE '_K_M' END IN {U.QUANT_TYPES} AS ok FROM part",
    "chat_filled": "SELECT conv_id, conv_id || ':' || turn AS msg_id, lag(conv_id || ':' || turn) OVER w AS parent_id, coalesce(lead(conv_id || ':' || turn) OVER w, '') AS children, role, coalesce(text, '') AS content FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "item_index": f"WITH {BLOCKS} SELECT block_id, item, start, stop, item_offset + item AS global_item, content FROM ix JOIN off USING (block_id)",
    "item_offsets": f"WITH {BLOCKS} SELECT block_id, n, item_offset FROM off",
    "position_to_item_inclusive": f"WITH {BLOCKS}, {POSITIONS} SELECT o_orderkey, block_id, pos, item FROM po JOIN ix USING (block_id) WHERE pos BETWEEN start AND stop",
    "position_to_item_halfopen": f"WITH {BLOCKS}, {POSITIONS} SELECT o_orderkey, block_id, pos, item FROM po JOIN ix USING (block_id) WHERE pos >= start AND pos < stop",
    "item_search": f"WITH {BLOCKS}, {text_cte(ITEM_TERMS, ITEM_SOURCE)}, {SCORE_CTE} SELECT doc_id.b AS block_id, doc_id.i AS item, text AS content, n, round({ADVANCED}, 6) AS score FROM s JOIN d USING (doc_id)",
    "item_search_block": f"""WITH {BLOCKS}, {text_cte(ITEM_TERMS, ITEM_SOURCE)}, {SCORE_CTE},
        bm AS (SELECT doc_id.b AS b, list_sort(list(start + pos)) AS ps, count(*) AS k FROM m JOIN ix ON ix.block_id = doc_id.b AND ix.item = doc_id.i GROUP BY 1),
        bs AS (SELECT b, k, CAST(k AS DOUBLE) / (SELECT max(stop) FROM ix WHERE block_id = b) AS share, list_reduce(list_transform(ps, lambda x: {{'c': 1, 's': x}}), lambda a, x: CASE WHEN x.s - a.s > 50 THEN {{'c': a.c + 1, 's': x.s}} ELSE a END).c AS bc FROM bm)
        SELECT * FROM (SELECT doc_id.b AS block_id, doc_id.i AS item, n, round(w * sqrt(u) * (1 + share) * (1 + 1 / CAST(bc AS DOUBLE)) * (1 + least(1.0, share)), 6) AS score FROM s JOIN bs ON b = doc_id.b) WHERE score >= 1""",
    "merge_results": """WITH k AS (SELECT CAST(l_suppkey AS VARCHAR) AS uri, l_partkey AS item, l_returnflag AS term, count(*) AS n FROM lineitem GROUP BY ALL),
        z AS (SELECT CAST(l_suppkey AS VARCHAR) AS uri, l_partkey AS item, count(*) AS n, arg_min(l_quantity, {'s': l_orderkey * 10 + l_linenumber, 'v': l_quantity}) AS score, arg_max(l_linestatus, {'s': l_orderkey * 10 + l_linenumber, 'v': l_linestatus}) AS content FROM lineitem GROUP BY ALL)
        SELECT z.*, (SELECT string_agg(term || ':' || k.n, ',' ORDER BY term) FROM k WHERE k.uri = z.uri AND k.item = z.item) AS counts FROM z""",
    "block_count": "SELECT p_partkey, greatest(1, p_partkey * 1048576 // (67108864 // 4)) * 4 - 1 AS blocks FROM part",
    "header_valid": "SELECT c_custkey, regexp_full_match(c_mktsegment, '[A-Za-z]{0,255}') AND (c_nationkey % 2 <> 0 OR regexp_full_match(c_name, '[A-Za-z]{0,255}')) AS ok FROM customer",
    "graph_nodes": f"WITH {NODES} SELECT * FROM nd", "graph_edges": f"WITH {EDGES} SELECT * FROM ed",
    "graph_upsert_node": f"WITH {NODES}, nw AS (SELECT 'C:' || s_suppkey AS uid, 'customer' AS type, 'name=' || s_name AS props FROM supplier) SELECT * FROM nd WHERE uid NOT IN (SELECT uid FROM nw) UNION ALL SELECT * FROM nw",
    "graph_update_node": f"""WITH {NODES}, ch AS (SELECT 'C:' || o_custkey AS uid, count(*) AS n FROM orders GROUP BY 1)
        SELECT uid, type, CASE WHEN n IS NULL THEN props ELSE string_split(props, ';')[1] || ';orders=' || n || ';segment=has orders' END AS props FROM nd LEFT JOIN ch USING (uid)""",
    "graph_remove_node": f"WITH {NODES} SELECT uid, type FROM nd WHERE uid NOT IN ('N:3', 'C:7', 'X:1')",
    "graph_remove_node_edges": f"WITH {EDGES} SELECT source, target, type FROM ed WHERE source NOT IN ('N:3', 'C:7', 'X:1') AND target NOT IN ('N:3', 'C:7', 'X:1')",
    "graph_removed_edges": f"WITH {EDGES} SELECT source, target, type FROM ed WHERE source IN ('N:3', 'C:7', 'X:1') OR target IN ('N:3', 'C:7', 'X:1')",
    "graph_add_edges": f"WITH {NODES}, {EDGES}, {MORE} SELECT source, target, type FROM ed UNION ALL SELECT source, target, 'ships_to' FROM mo WHERE source IN (SELECT uid FROM nd) AND target IN (SELECT uid FROM nd)",
    "graph_dangling_edges": f"WITH {NODES}, {MORE} SELECT source, target FROM mo WHERE source NOT IN (SELECT uid FROM nd) OR target NOT IN (SELECT uid FROM nd)",
    "graph_query_nodes": f"WITH {NODES} SELECT * FROM nd WHERE uid > 'C:5' AND type = 'customer' AND props LIKE '%;segment=BUILDING'",
    "graph_query_edges": f"WITH {EDGES} SELECT * FROM ed WHERE type = 'lives_in'", "graph_get_node": f"WITH {NODES} SELECT * FROM nd WHERE uid = 'C:42'",
    "graph_stats": f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges",
    "degrees": f"{DEGREES} SELECT *, in_degree + out_degree AS degree FROM dg",
    "degree_centrality": f"{DEGREES}, t AS (SELECT count(*) - 1 AS t FROM nd) SELECT uid, round(in_degree / t, 9) AS in_centrality, round(out_degree / t, 9) AS out_centrality, round((in_degree + out_degree) / t, 9) AS centrality FROM dg, t",
    "most_dependent_top10": f"{DEGREES} SELECT uid, in_degree FROM dg ORDER BY in_degree DESC, uid LIMIT 10", "most_dependencies_top10": f"{DEGREES} SELECT uid, out_degree FROM dg ORDER BY out_degree DESC, uid LIMIT 10",
    "node_link_json": f"""WITH {NODES}, {EDGES}, j AS (SELECT 'node' AS kind, uid AS key, '{{"id":"' || uid || '","type":"' || type AS head, props FROM nd UNION ALL SELECT 'link', source || '>' || target, '{{"source":"' || source || '","target":"' || target || '","type":"' || type, props FROM ed)
        SELECT kind, key, head || '","props":{{' || array_to_string(list_transform(string_split(props, ';'), lambda p: '"' || string_split(p, '=')[1] || '":"' || string_split(p, '=')[2] || '"'), ',') || '}}}}' AS json FROM j""",
    "graph_reload": f"WITH {NODES} SELECT * FROM nd",
    "graph_prompt": f"""WITH {NODES} SELECT uid, 'KGNODE► ' || uid || ' : ' || array_to_string(list_transform(string_split(props, ';'), lambda p: string_split(p, '=')[1] || '="' || string_split(p, '=')[2] || '"'), ', ') AS line FROM nd""",
    "version_history": f"{HISTORY} SELECT user_id, idx, event_id FROM h", "rollback_node": f"{HISTORY} SELECT user_id, event_id, event_type FROM h WHERE idx = 2",
    "versions_streamed": """WITH h AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
        f AS (SELECT user_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS data FROM h WHERE idx = 0)
        SELECT CAST(h.user_id AS VARCHAR) AS key, idx, CASE WHEN event_id % 7 <> 0 THEN event_type ELSE f.data END AS data, CASE WHEN event_id % 7 = 0 AND idx = 0 THEN 'no version 0' END AS error FROM h JOIN f USING (user_id)""",
    "state_as_of": "SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id",
    "snapshots": f"WITH {NODES} SELECT uid, type FROM nd WHERE type <> 'customer'",
    "snapshot_list": f"WITH {NODES} SELECT CAST(1 AS BIGINT) AS version, 'first' AS message, count(*) AS n FROM nd UNION ALL SELECT 2, 'no customers', count(*) FROM nd WHERE type <> 'customer'",
    "audit_log": "SELECT 'update_node' AS event, CAST(user_id AS VARCHAR) AS key, event_type AS kind, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL",
    "outcome_weights": "SELECT doc_id, CASE WHEN quality IS NOT DISTINCT FROM 1 - toxic THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight FROM labels",
    "property_filter": "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7' AND event_type = 'click'",
    "success_rate": "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS succeeded, round(count(*) FILTER (quality = 1) / count(*), 9) AS rate FROM labels",
    "success_rate_empty": "SELECT CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS succeeded, 0.0::DOUBLE AS rate",
    "format_size": f"SELECT p_partkey, {SIZE('(p_partkey * p_partkey * p_partkey)')} AS size FROM part",
    "duration_text": """SELECT o_orderkey, CASE WHEN t // 86400 = 0 THEN '' WHEN t // 86400 = 1 THEN '1 day, ' ELSE t // 86400 || ' days, ' END || printf('%d:%02d:%02d', t % 86400 // 3600, t % 3600 // 60, t % 60) AS took FROM (SELECT o_orderkey, o_orderkey * 37 AS t FROM orders)""",
    "size_percent": """SELECT p_partkey AS key, printf('%.2f GB', p_partkey * 1000000 / 1073741824.0::DOUBLE) AS size_text, CASE WHEN p_size % 5 = 0 THEN NULL ELSE printf('%.2f%%', round(100.0::DOUBLE * (p_partkey * 1000000) / (p_size * 100000000::BIGINT), 2)) END AS percent FROM part""",
    "keep_last_dedup": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id",
    "benchmark_rows": "SELECT p_name AS path, string_split(p_type, ' ')[1] AS type, CASE WHEN p_size % 10 = 0 THEN 'ERROR' ELSE CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_size % 10 = 0 THEN 'ERROR' ELSE p_partkey || '%' END AS percent, " + ", ".join(f"CASE WHEN p_size % 10 = 0 THEN 'ERROR' ELSE 'N/A' END AS {c}" for c in U.MEASURES if c not in ("size", "percent")) + " FROM part",
    "chat_links": """SELECT conv_id, turn, conv_id || ':' || turn AS msg_id, lag(conv_id || ':' || turn) OVER w AS parent_id, lead(conv_id || ':' || turn) OVER w AS child_id, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "chat_current": "SELECT conv_id, arg_max(conv_id || ':' || turn, turn) AS current_id, count(*) AS messages FROM conversations GROUP BY conv_id",
    "file_categories": "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) > 4096 THEN 'large' ELSE 'small' END AS category FROM documents",
    "file_filter": "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^http:') AND (regexp_matches(url, '/en/') OR regexp_matches(url, 'page='))",
    "suffix_supported": "SELECT page_id, regexp_matches(regexp_replace(url, '[#?].*', ''), '(\\.txt|\\.md|1|7)$') AS ok FROM pages".replace("\\\\", "\\"),
    "distance": "SELECT s_suppkey, round(sqrt(pow(s_acctbal - s_nationkey, 2) + pow(0.0 - 3, 2)), 6) AS d FROM supplier",
    "throughput": "SELECT count(*) AS items, round(sum(strlen(coalesce(text, ''))) / 1048576.0::DOUBLE / 2.0, 6) AS mb_per_s, round(count(*) / 2.0::DOUBLE, 6) AS items_per_s FROM documents",
    "cache_todo": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "cache_lookup": "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
}
