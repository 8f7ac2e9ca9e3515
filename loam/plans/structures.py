"""Registered queries over grids, code dependencies and graph-language programs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import deps as D
from loam.operators import dsl as L
from loam.operators import evaluation as E
from loam.operators import graph as N
from loam.operators import grids as G
from loam.operators import programs as P
from loam.operators import tabular as U
from loam.operators.match import spread
from loam.plans.search import table
from loam.sources.files import concatenated as all_sources
from loam.sources.files import task_of_result


def grids(spark, sf):
    """An 8 x 8 grid of 0 to 2 for each part, from the digest of its name, which is taken once, on all cores."""
    parts = spread(table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_name"), "key")
    h = parts.select("key", F.sha2(F.concat("p_name", F.lit(":"), F.col("key").cast("string")).cast("binary"), 256).alias("h"))
    # cells by name, not by a lambda: Spark would put the digest, used once there, inside it, and take it for each cell
    cell = lambda r, c: F.ascii(F.substring("h", r * 8 + c + 1, 1)) % 3
    return h.select("key", F.array(*(F.array(*(cell(r, c) for c in range(8))) for r in range(8))).alias("grid"))


def grid_shapes(spark, sf):
    s = G.shapes(grids(spark, sf), columns=())
    return s.select(F.col("key").cast("long"), "color", F.col("top").alias("box_top"), F.col("left").alias("box_left"), "height", "width", "x", "y", "size")


def moved():
    """Where a shape is predicted: those of colour 2 and one cell are moved up."""
    return F.when((F.col("color") == 2) & (F.col("size") == 1) & (F.col("key") % 2 == 0), F.col("y") + 1).otherwise(F.col("y"))


def predicted(found):
    """Shapes where they are predicted, and none for every seventh part."""
    return found.where("key % 7 <> 0").select("key", "x", moved().alias("y"))


def grid_evaluate(spark, sf):
    """The shapes are found once; each gives a row to either side, and the sides are folded to a row a grid."""
    sides = F.array(F.struct(F.lit(False).alias("told"), "y"), F.struct(F.lit(True).alias("told"), moved().alias("y")))
    rows = G.shapes(grids(spark, sf), columns=()).select("key", "x", F.explode(sides).alias("s")).select("key", "x", "s.*").where("NOT told OR key % 7 <> 0")
    return G.evaluate_sides(rows).select(F.col("key").cast("long"), "n_predicted", "n_actual", "success", "reason")


def task_rows(spark, sf):
    """Parts four to a task, as tests with an output grid."""
    k = F.col("key").cast("long")
    return grids(spark, sf).select(F.concat(F.lit("t"), F.floor(k / 4).cast("string")).alias("task_id"), F.lit("test").alias("split"), F.pmod(k, F.lit(4)).cast("int").alias("pair"), F.lit("output").alias("role"), "grid", "key")


def task_evaluate(spark, sf):
    told = predicted(G.shapes(grids(spark, sf), columns=())).withColumn("k", F.col("key").cast("long"))
    told = told.select(F.concat(F.lit("t"), F.floor(F.col("k") / 4).cast("string")).alias("task_id"), F.pmod("k", F.lit(4)).cast("int").alias("pair"), "x", "y")
    return G.evaluate_tasks(task_rows(spark, sf).drop("key"), told).drop("match_rate")


def task_summary(spark, sf):
    return U.success_rate(task_evaluate(spark, sf), F.col("success"))


def grid_similarity(spark, sf):
    """Descriptions of shapes by their size, against predictions that tell one size in four wrongly."""
    found = G.shapes(grids(spark, sf), columns=()).where("key % 5 = 0")
    text = lambda n: F.concat(F.lit("size "), n.cast("string"))
    told = found.select("key", "x", "y", text(F.when(F.col("x") % 4 == 3, 7).otherwise(F.col("size"))).alias("description"))
    out = G.evaluate(told, found.select("key", "x", "y", text(F.col("size")).alias("description")))
    return out.select(F.col("key").cast("long"), "success", "least", "mean", "most")


def grid_prompts(spark, sf):
    cache = spark.createDataFrame([("1", "one cell"), ("2", "one cell of two")], "grid_text string, description string")
    return G.prompts(G.described(G.shapes(grids(spark, sf)), cache))


def grid_responses(spark, sf):
    s = G.shapes(grids(spark, sf))
    part = F.concat(F.lit("SHAPE "), (F.col("shape") + 1).cast("string"), F.lit("\n\nPOS: "), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("\n\nDescription: of size "), F.col("size").cast("string"), F.lit("\n\n0110\n0000"))
    text = s.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shape", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))
    return G.parse_responses(text).select(F.col("key").cast("long"), F.col("shape").cast("long"), "x", "y", "description")


def files(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path")).distinct()


def code(spark, sf):
    name = F.regexp_replace("n_name", "[^A-Za-z0-9_]", "_")
    broken = F.when(F.col("n_nationkey") % 5 == 4, F.lit("\nimport (")).otherwise(F.lit(""))
    text = F.concat(F.lit("import os\nimport a."), name, F.lit("\nfrom b."), name, F.lit(" import x\ndef f():\n    from .c import y\n"), broken)
    return table(spark, sf, "nation").select(F.concat(F.lit("pkg/sub/"), name, F.lit(".py")).alias("path"), text.alias("text"))


def some_imports(spark, sf):
    """Each file imports, by number, a file's module, a path that exists, and a name alike."""
    f = files(spark, sf)
    module = F.regexp_replace("path", "/", ".")
    return f.select("path", F.lit("none").alias("base"), F.lit("import").alias("kind"), F.concat(module, F.when(F.length("path") % 2 == 0, F.lit("")).otherwise(F.lit("q"))).alias("module"))


def linked(spark, sf):
    return D.edges(D.resolve(some_imports(spark, sf), files(spark, sf)))


#: Programs by number: an end that is missing, plain blocks, blocks within blocks, a wrong entity with every other token, an unknown character, ELSE in a loop.
PROGRAM_TEXTS = (
    'C► NODE {uid} "make {name}" ◄\nIF► E► LINK l1 "ok?" ◄ N► 5 "go" ◄ ELSE► D► NODE zz "no" ◄ ◄ U► NODE {uid} "set"',
    'C► NODE {uid} "make {name}" ◄\nIF► E► LINK l1 "ok?" ◄ N► 5 "go" ◄ ELSE► D► NODE zz "no" ◄ ◄ U► NODE {uid} "set" ◄',
    'U► NODE {uid} "say \\"{name}\\"" ◄ LOOP► "until done" ◄ IF► E► NODE {uid} "ready" ◄ C► NODE in_{uid} "in" ◄ ELIF► N► 2.5 "look" ◄ N► "on" ◄ U► LINK l2 "far" ◄ '
    'ELIF► E► LINK l3 "else" ◄ LOOP► "in" ◄ ◄ ELSE► ◄ N► "after\\\\n" ◄ ◄ D► NODE other_{uid} "gone" ◄',
    'C► THING {uid} "x" ◄ {uid} >= 3.5 + (2, x); {y: "z"} END►',
    'U► NODE {uid} "{name}" ◄ D► NODE {uid} § "x" ◄',
    'LOOP► "a" ◄ ELSE► N► "b" ◄ ◄',
    'D► NODE {uid} "" ◄ U► NODE {uid} "lost" ◄',
)


#: Programs that run: commands alone, counted loops within loops, conditions with ELIF, a loop until a node is gone, one that does not end, an unknown condition, one that is not valid.
RUN_TEXTS = (
    'C► NODE {uid} "{name}" ◄ U► NODE {uid} "two" ◄ U► NODE lost "x" ◄ C► LINK {uid} "l" ◄ D► NODE absent "" ◄',
    'LOOP► "times 3" ◄ C► NODE {uid} "a" ◄ LOOP► "times 2" ◄ N► 1 "in" ◄ ◄ ◄ IF► E► NODE {uid} "is a" ◄ D► NODE {uid} "" ◄ ◄',
    'IF► E► NODE {uid} "exists" ◄ C► NODE b "1" ◄ ELIF► E► NODE {uid} "missing" ◄ C► NODE {uid} "made" ◄ LOOP► "{uid} exists" ◄ IF► E► NODE {uid} "is made" ◄ U► NODE {uid} "again" ◄ ELSE► D► NODE {uid} "" ◄ ◄ ◄ ELSE► C► NODE no "" ◄ ◄ C► NODE last "{name}" ◄',
    'C► NODE {uid} "x" ◄ LOOP► "other missing" ◄ U► NODE {uid} "on" ◄ ◄ C► NODE never "" ◄',
    'IF► E► LINK {uid} "ready" ◄ C► NODE a "1" ◄ ELSE► IF► E► NODE q "true" ◄ ELSE► C► NODE a "3" ◄ ◄ C► NODE a "4" ◄ ◄ E► NODE a "exists" ◄',
    'IF► E► NODE {uid} "exists" ◄',
)


def programs(spark, sf, texts=PROGRAM_TEXTS):
    """A program for each customer, by its number."""
    uid = F.concat(F.lit("n"), F.pmod("c_custkey", F.lit(50)).cast("string"))
    text = F.element_at(F.array(*(F.lit(t) for t in texts)), (F.col("c_custkey") % len(texts) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{uid}"), uid), F.lit("{name}"), F.col("c_name"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("program_id"), text.alias("text"))


def dsl_unquoted(spark, sf):
    """Names of parts as string tokens, each character by a number, between escapes of other kinds."""
    p = table(spark, sf, "part")
    coded = F.regexp_replace(F.hex(F.col("p_name").cast("binary")), "(..)", r"\\x$1")
    return p.select("p_partkey", L.unquote(F.concat(F.lit('"\\u00e9\\t'), coded, F.lit('\\101\\U0001F600 \\q\\""'))).alias("value"))


def result_names(spark, sf):
    """Tasks and test numbers of the names that results are saved under."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("t_"), F.col("p_partkey").cast("string"), F.lit("_test"), (F.col("p_size") % 3).cast("string"), F.lit("_result.json")).alias("name"))
    task, number = task_of_result(F.col("name"))
    return p.select("p_partkey", task.alias("task_id"), number.cast("long").alias("test"))


def concatenated(spark, sf):
    """Sources of the code under their headers."""
    return all_sources(code(spark, sf).select("path", "text"))


def similarity_classes(spark, sf):
    """Similar files of one directory: a row a directory, and the pairs that are more alike than it tells."""
    classes, exceptions = D.directory_similarity(files(spark, sf))
    return classes.select(F.col("dir").alias("a"), F.lit(None).cast("string").alias("b"), "pairs", "similarity").unionByName(exceptions.withColumn("pairs", F.lit(1).cast("long")))


def evaluation_graph(spark, sf):
    """Parts as nodes that are evaluated after those of half and a third of their number; some links lead back."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("uid"), "p_size")
    kind = F.element_at(F.array(F.lit("sum"), F.lit("least"), F.lit("greatest")), (F.col("p_size") % 3 + 1).cast("int"))
    n = p.select("uid", kind.alias("op"), F.col("p_size").cast("double").alias("value"), (F.col("p_size") % 7).cast("double").alias("target"))
    by = lambda k: p.where(F.col("uid") >= k).select(F.floor(F.col("uid") / k).alias("source"), F.col("uid").alias("target"))
    back = p.where("uid % 97 = 0").select(F.col("uid").alias("source"), F.floor(F.col("uid") / 2).alias("target"))
    return n, by(2).unionByName(by(3)).unionByName(back).withColumn("relation", F.lit("parameter"))


def evaluation_order(spark, sf):
    n, links = evaluation_graph(spark, sf)
    return E.levels(n, links)


def evaluation_results(spark, sf):
    n, links = evaluation_graph(spark, sf)
    return E.evaluate(n, links).select("uid", "result", "weight")


def dsl_execute(spark, sf):
    out = P.execute(L.syntax_trees(programs(spark, sf, RUN_TEXTS)), 40)
    held = F.array_join(F.transform(F.array_sort(F.map_entries("held")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("program_id", "status", "steps", "unknown", held.alias("held"))


def prompt_check(spark, sf):
    n = table(spark, sf, "nation")
    lead = F.element_at(F.array(F.lit("KG► graph\n"), F.lit('  {"KG►": 1} '), F.lit("no graph ")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return n.select("n_nationkey", L.serialized_prompt(F.concat(lead, "n_name")).alias("ok"))


def dsl_apply(spark, sf):
    base = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uid"), F.lit("nation").alias("type"), F.create_map(F.lit("name"), F.col("n_name")).alias("props"))
    out = L.apply_commands(base, L.syntax_trees(programs(spark, sf)))
    return out.select("uid", "type", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props"))


QUERIES = {
    "grid_dimensions": lambda s, d: grids(s, d).select("key", *(x.alias(n) for x, n in zip(G.dimensions(F.col("grid")), ("height", "width")))),
    "grid_bbox": lambda s, d: G.bounding_boxes(G.cells(grids(s, d), ["key"]).where("v <> 0"), ["key"]).select("key", F.col("top").alias("box_top"), F.col("left").alias("box_left"), "height", "width"),
    "grid_crop": lambda s, d: grids(s, d).select("key", G.compact_text(G.crop(F.col("grid"))).alias("t")),
    "grid_subgrid": lambda s, d: grids(s, d).select("key", G.compact_text(G.subgrid(F.col("grid"), F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("t")),
    "grid_format": lambda s, d: grids(s, d).select("key", G.ascii_text(F.col("grid")).alias("t"), G.compact_text(G.parse_text(G.compact_text(F.col("grid")))).alias("again")),
    "grid_shapes": grid_shapes, "grid_evaluate": grid_evaluate, "grid_similarity": grid_similarity, "grid_prompts": grid_prompts, "grid_responses": grid_responses,
    "module_mapping": lambda s, d: D.module_mapping(files(s, d)), "import_extraction": lambda s, d: D.imports(code(s, d), {"os"}),
    "import_resolution": lambda s, d: D.resolve(some_imports(s, d), files(s, d)).select("path", "module", "target"),
    "dependency_edges": lambda s, d: D.edges(D.resolve(some_imports(s, d), files(s, d))),
    "dependency_report": lambda s, d: N.degrees(files(s, d).withColumnRenamed("path", "uid"), D.edges(D.resolve(some_imports(s, d), files(s, d)))),
    "similarity_pairs": lambda s, d: D.similar_pairs(files(s, d)), "similarity_classes": similarity_classes, "blended_clusters": lambda s, d: D.blended_clusters(files(s, d), D.edges(D.resolve(some_imports(s, d), files(s, d))), 0.4),
    "average_linkage": lambda s, d: D.average_linkage(files(s, d), linked(s, d)).select("a", "b", F.round("similarity", 6).alias("similarity")), "average_clusters": lambda s, d: D.average_clusters(files(s, d), linked(s, d), 8),
    "task_evaluate": task_evaluate, "task_summary": task_summary, "directory_clusters": lambda s, d: D.directory_clusters(files(s, d), 5),
    "node_sizes": lambda s, d: table(s, d, "nation").select("n_nationkey", F.round(D.node_size(F.col("n_nationkey")), 9).alias("size"), D.label_size(F.col("n_nationkey")).cast("long").alias("font")),
    "dsl_tokens": lambda s, d: L.tokens_of(programs(s, d)).select("program_id", "seq", "type", "value"),
    "dsl_commands": lambda s, d: L.syntax_trees(programs(s, d)).where("kind <> 'error'").select("program_id", "node_id", "parent_id", "branch", "seq", "kind", "uid", "instruction"),
    "dsl_valid": lambda s, d: L.validity(programs(s, d)), "dsl_apply": dsl_apply, "dsl_statistics": lambda s, d: L.statistics(programs(s, d)), "prompt_check": prompt_check, "dsl_unquoted": dsl_unquoted, "dsl_execute": dsl_execute, "result_names": result_names, "concatenated": concatenated,
    "evaluation_order": evaluation_order, "evaluation_results": evaluation_results,
}

GRID = """g AS (SELECT p_partkey AS key, sha256(p_name || ':' || p_partkey) AS h FROM part),
cell AS (SELECT key, i // 8 AS r, i % 8 AS c, ascii(substr(h, CAST(i + 1 AS INTEGER), 1)) % 3 AS v FROM (SELECT *, unnest(range(64)) AS i FROM g))"""
SHAPE = f"""{GRID}, nz AS (SELECT * FROM cell WHERE v <> 0),
reach(key, r, c, v, l) AS (SELECT key, r, c, v, r * 8 + c FROM nz UNION SELECT n.key, n.r, n.c, n.v, reach.l FROM reach JOIN nz n ON n.key = reach.key AND n.v = reach.v AND abs(n.r - reach.r) <= 1 AND abs(n.c - reach.c) <= 1),
lab AS (SELECT key, r, c, v, min(l) AS l FROM reach GROUP BY 1, 2, 3, 4),
sh AS (SELECT key, v AS color, min(r) AS box_top, min(c) AS box_left, max(r) - min(r) + 1 AS height, max(c) - min(c) + 1 AS width, min(c) AS x, 7 - min(r) AS y, count(*) AS size FROM lab GROUP BY key, v, l)"""
#: Shapes numbered from 1 within their grid, by colour and first cell.
NUMBERED = f"""{SHAPE}, sn AS (SELECT key, min(r) AS t, max(r) AS b, min(c) AS a, max(c) AS z, count(*) AS size, row_number() OVER (PARTITION BY key ORDER BY v, l) AS k FROM lab GROUP BY key, v, l)"""
ROWS = "SELECT key, r, string_agg(v, '' ORDER BY c) AS t FROM cell"
FILES = "f AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"
#: Imports with the mapped file, the first path that exists, and the first file of a like name.
RESOLVED = f"""{FILES}, ps AS (SELECT path, string_split(replace(regexp_replace(path, '([^/])\\.[^./]*$', '\\1'), '/', '.'), '.') AS ps FROM f),
mp AS (SELECT module, min(path) AS mapped FROM (SELECT path, array_to_string(ps[1:i], '.') AS module FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM ps)) WHERE module <> '' GROUP BY module),
nm AS (SELECT path, lower(string_split(path, '/')[-1]) AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM f),
im AS (SELECT path, dir, replace(path, '/', '.') || CASE WHEN length(path) % 2 = 0 THEN '' ELSE 'q' END AS module FROM nm),
ca AS (SELECT path, generate_subscripts(cs, 1) AS rank, unnest(cs) AS candidate FROM (SELECT path, [x || '.py', x || '/__init__.py', y || '.py', y || '/__init__.py'] AS cs FROM (SELECT path, x, CASE WHEN dir = '' THEN x ELSE dir || '/' || x END AS y FROM (SELECT path, dir, replace(module, '.', '/') AS x FROM im)))),
bp AS (SELECT ca.path, arg_min(candidate, rank) AS by_path FROM ca JOIN f ON f.path = candidate GROUP BY ca.path),
al AS (SELECT im.path, min(o.path) AS alike FROM im JOIN nm o ON o.path <> im.path AND (o.name = 'none.py' OR lower(string_split(o.dir, '/')[-1]) = 'none' OR (replace(o.name, '.py', '') <> '' AND ends_with(lower(module), replace(o.name, '.py', '')))) GROUP BY im.path),
rs AS (SELECT im.path, module, coalesce(mapped, by_path, alike) AS target FROM im LEFT JOIN mp USING (module) LEFT JOIN bp ON bp.path = im.path LEFT JOIN al ON al.path = im.path),
de AS (SELECT DISTINCT path AS source, target FROM rs WHERE target <> path)"""
#: All pairs of files and their path similarity.
SIMILAR = """s AS (SELECT path, string_split(path, '/') AS ps, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM f),
q AS (SELECT a.path AS a, b.path AS b, a.dir AS da, b.dir AS db, regexp_replace(a.ps[-1], '(.)\\.[^.]*$', '\\1') AS x, regexp_replace(b.ps[-1], '(.)\\.[^.]*$', '\\1') AS y, least(len(a.ps), len(b.ps)) AS k,
      len(list_filter(range(1, least(len(a.ps), len(b.ps)) + 1), lambda i: a.ps[1:i] = b.ps[1:i])) AS m FROM s a JOIN s b ON a.path < b.path),
sm AS (SELECT a, b, least(1.0, CAST(m AS DOUBLE) / k + CASE WHEN da = db THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN starts_with(x, y) OR starts_with(y, x) OR ends_with(x, y) OR ends_with(y, x) THEN 0.2::DOUBLE ELSE 0 END) AS sim FROM q)"""
#: Parts four to a task; the predictions of grid_evaluate.
TASKS = """pr AS (SELECT key, x, CASE WHEN color = 2 AND size = 1 AND key % 2 = 0 THEN y + 1 ELSE y END AS y FROM sh WHERE key % 7 <> 0),
a AS (SELECT key, count(*) AS n, list_sort(list(DISTINCT {'x': x, 'y': y})) AS ps FROM sh GROUP BY key), b AS (SELECT key, count(*) AS n, list_sort(list(DISTINCT {'x': x, 'y': y})) AS ps FROM pr GROUP BY key),
te AS (SELECT 't' || key // 4 AS task_id, CAST(key % 4 AS INTEGER) AS pair, coalesce(b.n, 0) AS n_predicted, a.n AS n_actual, coalesce(a.n = b.n AND a.ps = b.ps AND len(a.ps) = a.n, false) AS success,
  CASE WHEN a.n <> coalesce(b.n, 0) THEN 'count' WHEN a.ps <> b.ps THEN 'position' WHEN len(a.ps) <> a.n THEN 'duplicate' ELSE '' END AS reason FROM a LEFT JOIN b USING (key))"""
#: Links of clusters at each step, of which the best merges: the similarity is s / (na * nb), names are least members.
LINKAGE = f"""{RESOLVED}, {SIMILAR}, tt AS (SELECT count(*) AS total FROM de), ad AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM de GROUP BY ALL),
lk AS (SELECT a, b, CAST(round((1 - round(1 - (0.7::DOUBLE * sim + 0.3::DOUBLE * coalesce(n / total, 0)), 9)) * 1000000000) AS BIGINT) AS s FROM sm LEFT JOIN ad USING (a, b), tt WHERE round(sim, 9) >= 0.7 OR n IS NOT NULL),
li(step, a, b, s, na, nb) AS (SELECT 0, a, b, s, 1, 1 FROM lk WHERE s > 0 UNION ALL
  SELECT step + 1, least(x, y), greatest(x, y), CAST(sum(s) AS BIGINT), max(CASE WHEN x < y THEN nx ELSE ny END), max(CASE WHEN x < y THEN ny ELSE nx END) FROM (
    SELECT li.step, li.s, CASE WHEN li.a = m.b THEN m.a ELSE li.a END AS x, CASE WHEN li.b = m.b THEN m.a ELSE li.b END AS y, CASE WHEN li.a IN (m.a, m.b) THEN m.na + m.nb ELSE li.na END AS nx, CASE WHEN li.b IN (m.a, m.b) THEN m.na + m.nb ELSE li.nb END AS ny
    FROM li, (SELECT a, b, na, nb FROM li ORDER BY s / (na * nb) DESC, a, b LIMIT 1) m WHERE NOT (li.a = m.a AND li.b = m.b)) GROUP BY step, least(x, y), greatest(x, y)),
dg AS (SELECT step, a, b, s / (na * nb) / 1000000000 AS similarity FROM li QUALIFY row_number() OVER (PARTITION BY step ORDER BY s / (na * nb) DESC, a, b) = 1)"""
#: Nodes nd and links ln of evaluation_graph; lv: levels of the nodes that no cycle leads to.
CHAINED = """nd AS (SELECT p_partkey AS uid, CASE p_size % 3 WHEN 0 THEN 'sum' WHEN 1 THEN 'least' ELSE 'greatest' END AS op, CAST(p_size AS DOUBLE) AS value, CAST(p_size % 7 AS DOUBLE) AS target FROM part),
ln AS (SELECT uid // 2 AS source, uid AS target FROM nd WHERE uid >= 2 AND uid // 2 IN (SELECT uid FROM nd) UNION SELECT uid // 3, uid FROM nd WHERE uid >= 3 AND uid // 3 IN (SELECT uid FROM nd) UNION SELECT uid, uid // 2 FROM nd WHERE uid % 97 = 0),
rc(a, b) AS (SELECT source, target FROM ln UNION SELECT rc.a, ln.target FROM rc JOIN ln ON ln.source = rc.b),
cy AS (SELECT a AS uid FROM rc WHERE a = b UNION SELECT b FROM rc WHERE a IN (SELECT a FROM rc WHERE a = b)),
wl(uid, level) AS (SELECT uid, 0 FROM nd WHERE uid NOT IN (SELECT target FROM ln) UNION SELECT ln.target, level + 1 FROM wl JOIN ln ON ln.source = wl.uid WHERE ln.target NOT IN (SELECT uid FROM cy)),
lv AS (SELECT uid, max(level) AS level FROM wl GROUP BY uid)"""
def programs_sql(texts) -> str:
    return f"""p AS (SELECT c_custkey AS program_id, replace(replace(([{', '.join("'" + t + "'" for t in texts)}])[c_custkey % {len(texts)} + 1], '{{uid}}', 'n' || c_custkey % 50), '{{name}}', c_name) AS text FROM customer)"""


PROGRAMS = programs_sql(PROGRAM_TEXTS)
QUOTED = r'"(?:[^"\\]|\\.)*"'
PARTS = rf"[CUDE]►\s*(?:NODE|LINK)\s+[A-Za-z_][A-Za-z0-9_]*\s*{QUOTED}\s*◄|N►\s*(?:[0-9]+(?:\.[0-9]+)?)?\s*{QUOTED}\s*◄|LOOP►\s*{QUOTED}\s*◄|ELIF►|ELSE►|IF►|◄|\s+|(?s:.)"
#: Parts of the texts as letters, and whether blocks reduce to statements.
CHECKED = rf"""{PROGRAMS}, pa AS (SELECT program_id, list_filter(regexp_extract_all(text, '{PARTS}'), lambda t: NOT regexp_full_match(t, '\s+')) AS ps FROM p),
le AS (SELECT program_id, ps, list_transform(ps, lambda t: CASE t WHEN 'IF►' THEN 'i' WHEN 'ELIF►' THEN 'e' WHEN 'ELSE►' THEN 'l' WHEN '◄' THEN 'x' ELSE CASE WHEN starts_with(t, 'LOOP►') THEN 'o' WHEN ends_with(t, '◄') THEN 'c' ELSE '?' END END) AS ks FROM pa),
rd(program_id, s) AS (SELECT program_id, array_to_string(ks, '') FROM le UNION ALL SELECT program_id, regexp_replace(s, '(ic[cb]*(ec[cb]*)*(l[cb]*)?|o[cb]*)x', 'b', 'g') FROM rd WHERE regexp_matches(s, '(ic[cb]*(ec[cb]*)*(l[cb]*)?|o[cb]*)x')),
va AS (SELECT program_id, bool_or(regexp_full_match(s, '[cb]*')) AS valid FROM rd GROUP BY program_id)"""
#: The statements of valid programs, read part by part with a stack of open blocks.
STATEMENTS = rf"""{CHECKED}, st(program_id, i, n, k, part, ps, ks, stack, parent_id, branch, seq) AS (
  SELECT program_id, 0, 0, '', '', ps, ks, [{{'id': -1, 'b': 'top', 's': 0, 'c': false, 'e': 0}}], -1, '', 0 FROM le JOIN va USING (program_id) WHERE valid
  UNION ALL
  SELECT program_id, i + 1, n + CASE WHEN ks[i + 1] IN ('c', 'i', 'o') THEN 1 ELSE 0 END, ks[i + 1], ps[i + 1], ps, ks,
    CASE ks[i + 1] WHEN 'x' THEN stack[:-2]
      WHEN 'e' THEN list_append(stack[:-2], {{'id': stack[-1].id, 'b': 'elif' || stack[-1].e, 's': 0, 'c': true, 'e': stack[-1].e + 1}})
      WHEN 'l' THEN list_append(stack[:-2], {{'id': stack[-1].id, 'b': 'else', 's': 0, 'c': false, 'e': stack[-1].e}})
      ELSE list_concat(list_append(stack[:-2], {{'id': stack[-1].id, 'b': stack[-1].b, 's': stack[-1].s + CASE WHEN stack[-1].c THEN 0 ELSE 1 END, 'c': false, 'e': stack[-1].e}}),
        CASE ks[i + 1] WHEN 'i' THEN [{{'id': n, 'b': 'if', 's': 0, 'c': true, 'e': 0}}] WHEN 'o' THEN [{{'id': n, 'b': 'loop', 's': 0, 'c': false, 'e': 0}}] ELSE [] END) END,
    stack[-1].id, stack[-1].b || CASE WHEN stack[-1].c THEN '_condition' ELSE '' END, CASE WHEN stack[-1].c THEN 0 ELSE stack[-1].s END
  FROM st WHERE i < len(ks)),
cm AS (SELECT program_id, n - 1 AS node_id, parent_id, branch, seq, CASE k WHEN 'i' THEN 'if' WHEN 'o' THEN 'loop' ELSE CASE part[1] WHEN 'C' THEN 'create' WHEN 'U' THEN 'update' WHEN 'D' THEN 'delete' WHEN 'E' THEN 'evaluate' ELSE 'navigate' END END AS kind,
  nullif(regexp_extract(part, '^[CUDE]►\s*(NODE|LINK)', 1), '') AS entity, nullif(regexp_extract(part, '^[CUDE]►\s*\w+\s+(\w+)', 1), '') AS uid,
  CASE WHEN k <> 'i' THEN replace(replace(replace(replace(regexp_extract(part, '(?s)"(.*)"', 1), '\\', chr(1)), '\"', '"'), '\n', chr(10)), chr(1), '\') END AS instruction FROM st WHERE k IN ('c', 'i', 'o'))"""

ORACLES = {
    "grid_dimensions": "SELECT p_partkey AS key, 8 AS height, 8 AS width FROM part",
    "grid_bbox": f"WITH {GRID} SELECT key, min(r) AS box_top, min(c) AS box_left, max(r) - min(r) + 1 AS height, max(c) - min(c) + 1 AS width FROM cell WHERE v <> 0 GROUP BY key",
    "grid_crop": f"WITH {GRID}, b AS (SELECT key, min(r) AS t, max(r) AS u, min(c) AS l, max(c) AS m FROM cell WHERE v <> 0 GROUP BY key), x AS (SELECT key, r, string_agg(v, '' ORDER BY c) AS t FROM cell JOIN b USING (key) WHERE r BETWEEN b.t AND u AND c BETWEEN l AND m GROUP BY key, r) SELECT key, string_agg(t, chr(10) ORDER BY r) AS t FROM x GROUP BY key",
    "grid_subgrid": f"WITH {GRID}, x AS ({ROWS} WHERE r BETWEEN 1 AND 3 AND c BETWEEN 2 AND 5 GROUP BY key, r) SELECT key, string_agg(t, chr(10) ORDER BY r) AS t FROM x GROUP BY key",
    "grid_format": f"WITH {GRID}, x AS (SELECT key, r, string_agg(v, '' ORDER BY c) AS a, string_agg(lpad(CAST(v AS VARCHAR), 2, ' '), ' ' ORDER BY c) AS b FROM cell GROUP BY key, r) SELECT key, string_agg(b, chr(10) ORDER BY r) AS t, string_agg(a, chr(10) ORDER BY r) AS again FROM x GROUP BY key",
    "grid_shapes": f"WITH RECURSIVE {SHAPE} SELECT * FROM sh",
    "grid_evaluate": f"""WITH RECURSIVE {SHAPE}, pr AS (SELECT key, x, CASE WHEN color = 2 AND size = 1 AND key % 2 = 0 THEN y + 1 ELSE y END AS y FROM sh WHERE key % 7 <> 0),
        a AS (SELECT key, count(*) AS n, list_sort(list(DISTINCT {{'x': x, 'y': y}})) AS ps FROM sh GROUP BY key), b AS (SELECT key, count(*) AS n, list_sort(list(DISTINCT {{'x': x, 'y': y}})) AS ps FROM pr GROUP BY key),
        e AS (SELECT key, coalesce(b.n, 0) AS n_predicted, coalesce(a.n, 0) AS n_actual, CASE WHEN coalesce(a.n, 0) <> coalesce(b.n, 0) THEN 'count' WHEN a.ps <> b.ps THEN 'position' WHEN len(a.ps) <> a.n THEN 'duplicate' ELSE '' END AS reason FROM a FULL JOIN b USING (key))
        SELECT key, n_predicted, n_actual, reason = '' AS success, reason FROM e""",
    "grid_similarity": f"""WITH RECURSIVE {SHAPE}, a AS (SELECT key, x, y, count(*) AS n, max('size ' || size) AS d, max('size ' || CASE WHEN x % 4 = 3 THEN 7 ELSE size END) AS t FROM sh WHERE key % 5 = 0 GROUP BY key, x, y),
        b AS (SELECT key, n, CASE WHEN d = t THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (5 + CASE WHEN contains(substr(d, 6), '7') THEN 1 ELSE 0 END) / (length(d) + length(t)) END AS s FROM a)
        SELECT key, max(n) = 1 AS success, round(min(s), 9) AS least, round(avg(s), 9) AS mean, round(max(s), 9) AS most FROM b GROUP BY key""",
    "grid_prompts": f"""WITH RECURSIVE {NUMBERED}, ro AS (SELECT sn.key, k, cell.r, string_agg(lpad(CAST(cell.v AS VARCHAR), 2, ' '), ' ' ORDER BY cell.c) AS padded, string_agg(cell.v, '' ORDER BY cell.c) AS plain FROM sn JOIN cell ON cell.key = sn.key AND cell.r BETWEEN t AND b AND cell.c BETWEEN a AND z GROUP BY sn.key, k, cell.r),
        gr AS (SELECT key, k, string_agg(padded, chr(10) ORDER BY r) AS grid, string_agg(plain, chr(10) ORDER BY r) AS asked FROM ro GROUP BY key, k)
        SELECT CAST(key AS VARCHAR) AS key, 'INPUT SHAPES:' || chr(10) || string_agg('SHAPE ' || k || chr(10) || 'POS: ' || a || ',' || (7 - t) || chr(10) || grid || chr(10) || 'DESCRIPTION: ' || CASE asked WHEN '1' THEN 'one cell' WHEN '2' THEN 'one cell of two' ELSE 'Shape description unavailable' END, chr(10) || chr(10) ORDER BY k) AS prompt
        FROM sn JOIN gr USING (key, k) GROUP BY key""",
    "grid_responses": f"WITH RECURSIVE {NUMBERED} SELECT key, k AS shape, a AS x, 7 - t AS y, 'Description: of size ' || size AS description FROM sn",
    "import_resolution": f"WITH {RESOLVED} SELECT path, module, target FROM rs", "dependency_edges": f"WITH {RESOLVED} SELECT source, target FROM de",
    "dependency_report": f"WITH {RESOLVED} SELECT path AS uid, i AS in_degree, o AS out_degree, i + o AS degree FROM (SELECT path, (SELECT count(*) FROM de WHERE target = path) AS i, (SELECT count(*) FROM de WHERE source = path) AS o FROM f)",
    "module_mapping": f"WITH {FILES}, s AS (SELECT path, string_split(replace(regexp_replace(path, '([^/])\\.[^./]*$', '\\1'), '/', '.'), '.') AS ps FROM f), m AS (SELECT path, array_to_string(ps[1:i], '.') AS module FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM s)) SELECT module, min(path) AS path FROM m WHERE module <> '' GROUP BY module",
    "import_extraction": """WITH n AS (SELECT regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') AS n FROM nation WHERE n_nationkey % 5 <> 4)
        SELECT 'pkg/sub/' || n || '.py' AS path, 'a' AS base, 'import' AS kind, 'a.' || n AS module FROM n UNION ALL SELECT 'pkg/sub/' || n || '.py', 'b', 'from_absolute', 'b.' || n FROM n UNION ALL SELECT 'pkg/sub/' || n || '.py', 'c', 'from_relative', 'pkg.c' FROM n""",
    "similarity_pairs": f"WITH {FILES}, {SIMILAR} SELECT a, b, round(sim, 9) AS similarity FROM sm WHERE round(sim, 9) >= 0.7",
    "similarity_classes": f"""WITH {FILES}, {SIMILAR}, cl AS (SELECT dir, count(*) AS n, round(least(1.0, CAST(len(any_value(ps)) - 1 AS DOUBLE) / len(any_value(ps)) + 0.3::DOUBLE), 9) AS base FROM s GROUP BY dir)
        SELECT dir AS a, NULL AS b, n * (n - 1) // 2 AS pairs, base AS similarity FROM cl WHERE n > 1 AND base >= 0.7
        UNION ALL SELECT sm.a, sm.b, 1, round(sim, 9) FROM sm JOIN q USING (a, b) JOIN cl ON cl.dir = q.da WHERE q.da = q.db AND round(sim, 9) > base AND round(sim, 9) >= 0.7""",
    "blended_clusters": f"""WITH RECURSIVE {RESOLVED}, {SIMILAR}, tt AS (SELECT count(*) AS total FROM de), ad AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM de GROUP BY ALL),
        lk AS (SELECT a, b FROM sm LEFT JOIN ad USING (a, b), tt WHERE (round(sim, 9) >= 0.7 OR n IS NOT NULL) AND round(1 - (0.7::DOUBLE * sim + 0.3::DOUBLE * coalesce(n / total, 0)), 9) <= 0.4),
        bo AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), rc(path, seen) AS (SELECT path, path FROM f UNION SELECT rc.path, bo.b FROM rc JOIN bo ON bo.a = rc.seen)
        SELECT path, min(seen) AS cluster FROM rc GROUP BY path""",
    "directory_clusters": f"""WITH RECURSIVE {FILES}, dr AS (SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM f),
        h(l) AS (SELECT list_sort(list({{'n': n, 'd': dir, 'm': [dir]}})) FROM (SELECT dir, count(*) AS n FROM dr GROUP BY dir)
            UNION ALL SELECT list_sort(list_append(l[3:], {{'n': l[1].n + l[2].n, 'd': least(l[1].d, l[2].d), 'm': list_concat(l[1].m, l[2].m)}})) FROM h WHERE len(l) > 5),
        c AS (SELECT x.m AS m, CAST(row_number() OVER (ORDER BY x.d) - 1 AS INTEGER) AS cluster FROM (SELECT unnest(l) AS x FROM h WHERE len(l) <= 5)),
        cd AS (SELECT unnest(m) AS dir, cluster FROM c) SELECT path, cluster FROM dr JOIN cd USING (dir)""",
    "average_linkage": f"WITH RECURSIVE {LINKAGE} SELECT a, b, round(similarity, 6) AS similarity FROM dg",
    "average_clusters": f"""WITH RECURSIVE {LINKAGE}, nt AS (SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM dg) AS done),
        kp AS (SELECT a, b FROM dg, nt WHERE step < files - 8), up(path, root) AS (SELECT path, path FROM f UNION SELECT up.path, kp.a FROM up JOIN kp ON kp.b = up.root), rt AS (SELECT path, min(root) AS root FROM up GROUP BY path),
        rn AS (SELECT root, row_number() OVER (ORDER BY root DESC) AS i, min(root) OVER () AS least FROM (SELECT DISTINCT root FROM rt))
        SELECT path, CASE WHEN i < 8 THEN root ELSE least END AS cluster FROM rt JOIN rn USING (root)""",
    "task_evaluate": f"""WITH RECURSIVE {SHAPE}, {TASKS} SELECT task_id, pair, n_predicted, n_actual, success, reason FROM te""",
    "task_summary": f"""WITH RECURSIVE {SHAPE}, {TASKS} SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, round(count(*) FILTER (success) / count(*), 9) AS rate FROM te""",
    "node_sizes": "SELECT n_nationkey, round(4 + 8 * sqrt(n_nationkey + 1), 9) AS size, CASE WHEN n_nationkey > 10 THEN least(24, 12 + (n_nationkey - 10) // 2) ELSE 0 END AS font FROM nation",
    "dsl_tokens": rf"""WITH {PROGRAMS}, t AS (SELECT program_id, regexp_extract_all(text, '(?:C►|U►|D►|E►|N►|IF►|ELIF►|ELSE►|LOOP►|END►|◄|[0-9]+(?:\.[0-9]+)?|{QUOTED}|[A-Za-z_][A-Za-z0-9_]*|==|!=|<=|>=|[+*/<>-]|[{{}}(),:;]|\s+|(?s:.))') AS vs FROM p),
        u AS (SELECT program_id, unnest(vs) AS value, generate_subscripts(vs, 1) AS i, vs FROM t),
        k AS (SELECT *, CASE WHEN value = '◄' THEN 'CLOSE' WHEN ends_with(value, '►') AND length(value) > 1 THEN 'KEYWORD' WHEN starts_with(value, '"') AND length(value) > 1 THEN 'STRING' WHEN regexp_full_match(value, '[0-9.]*[0-9]') THEN 'NUMBER'
            WHEN regexp_full_match(value, '[A-Za-z_][A-Za-z0-9_]*') THEN 'IDENT' WHEN regexp_full_match(value, '[=!<>+*/-]+') THEN 'OP' WHEN regexp_full_match(value, '[{{}}(),:;]') THEN 'SYMBOL' WHEN regexp_full_match(value, '\s+') THEN 'WS' ELSE 'ERROR' END AS type FROM u),
        e AS (SELECT program_id, min(i) AS wrong FROM k WHERE type = 'ERROR' GROUP BY program_id)
        SELECT program_id, CASE WHEN wrong IS NULL THEN row_number() OVER (PARTITION BY program_id ORDER BY i) - 1 ELSE 0 END AS seq, type,
            CASE WHEN wrong IS NULL THEN value ELSE 'unexpected character ' || chr(39) || value || chr(39) || ' at ' || length(array_to_string(vs[:i - 1], '')) END AS value
        FROM k LEFT JOIN e USING (program_id) WHERE type <> 'WS' AND (wrong IS NULL OR i = wrong)""",
    "dsl_commands": f"WITH RECURSIVE {STATEMENTS} SELECT program_id, node_id, parent_id, branch, seq, kind, uid, instruction FROM cm",
    "dsl_valid": f"WITH RECURSIVE {CHECKED} SELECT program_id, valid FROM va",
    "dsl_statistics": f"WITH RECURSIVE {CHECKED} SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid FROM va",
    "dsl_apply": f"""WITH RECURSIVE {STATEMENTS}, b AS (SELECT 'n' || n_nationkey AS uid, n_name FROM nation),
        t AS (SELECT uid, list(CASE kind WHEN 'create' THEN '+' WHEN 'delete' THEN '-' ELSE '~' END || instruction ORDER BY program_id, node_id) AS steps FROM cm WHERE parent_id = -1 AND entity = 'NODE' AND kind IN ('create', 'update', 'delete') GROUP BY uid),
        z AS (SELECT uid, n_name, list_reduce(list_concat([CASE WHEN n_name IS NULL THEN '-' ELSE '.' END], coalesce(steps, [])), lambda x, y: CASE WHEN y[1] <> '~' THEN y WHEN x[1] = '-' THEN x ELSE x[1] || y[2:] END) AS s FROM b FULL JOIN t USING (uid))
        SELECT uid, CASE WHEN s[1] = '+' THEN 'node' ELSE 'nation' END AS type, CASE WHEN s[1] = '+' THEN 'instruction=' || s[2:] WHEN s = '.' THEN 'name=' || n_name ELSE 'instruction=' || s[2:] || ';name=' || n_name END AS props FROM z WHERE s[1] <> '-'""",
    "dsl_unquoted": r"""SELECT p_partkey, chr(233) || chr(9) || p_name || 'A' || chr(128512) || ' \q"' AS value FROM part""",
    "result_names": "SELECT p_partkey, 't_' || p_partkey AS task_id, p_size % 3 AS test FROM part",
    "concatenated": r"""WITH n AS (SELECT regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') AS n, n_nationkey FROM nation)
        SELECT 'pkg/sub/' || n || '.py' AS path, repeat('#', 79) || chr(10) || '# pkg/sub/' || n || '.py' || chr(10) || repeat('#', 79) || chr(10) || chr(10)
            || 'import os' || chr(10) || 'import a.' || n || chr(10) || 'from b.' || n || ' import x' || chr(10) || 'def f():' || chr(10) || '    from .c import y' || chr(10) || CASE WHEN n_nationkey % 5 = 4 THEN chr(10) || 'import (' ELSE '' END || chr(10) AS text FROM n""",
    "evaluation_order": f"WITH RECURSIVE {CHAINED} SELECT n.uid, level, level IS NULL AS cyclic FROM nd n LEFT JOIN lv USING (uid)",
    "evaluation_results": f"""WITH RECURSIVE {CHAINED}, re(step, uid, result) AS (SELECT 0, uid, value FROM nd JOIN lv USING (uid) WHERE level = 0
            UNION ALL SELECT step + 1, uid, result FROM (SELECT step, uid, result FROM re WHERE step < (SELECT max(level) FROM lv)
                UNION ALL SELECT re.step, n.uid, CASE n.op WHEN 'sum' THEN n.value + sum(re.result) WHEN 'least' THEN least(n.value, min(re.result)) ELSE greatest(n.value, max(re.result)) END
                FROM re JOIN ln ON ln.source = re.uid JOIN nd n ON n.uid = ln.target JOIN lv ON lv.uid = n.uid AND lv.level = re.step + 1 GROUP BY re.step, n.uid, n.op, n.value))
        SELECT n.uid, r.result, CASE WHEN r.uid IS NULL THEN NULL WHEN r.result IS NOT DISTINCT FROM n.target THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight
        FROM nd n LEFT JOIN (SELECT DISTINCT uid, result FROM re WHERE step = (SELECT max(level) FROM lv)) r USING (uid)""",
    "dsl_execute": f"""WITH RECURSIVE {STATEMENTS.replace(PROGRAMS, programs_sql(RUN_TEXTS))},
        cx AS (SELECT program_id, node_id AS n, parent_id AS p, branch AS b, regexp_replace(branch, '_condition$', '') AS bb, ends_with(branch, '_condition') AS cond, kind, lower(entity) || ':' || uid AS key, instruction,
            lead(node_id) OVER (PARTITION BY program_id, parent_id, branch ORDER BY node_id) AS sib FROM cm),
        up(program_id, n, pl, f) AS (SELECT program_id, n, n, CAST(NULL AS BIGINT) FROM cx UNION ALL SELECT u.program_id, u.n, c.p, CASE WHEN c.sib IS NOT NULL THEN c.sib WHEN c.p = -1 THEN -1 WHEN k.kind = 'loop' THEN c.p END
            FROM up u JOIN cx c ON c.program_id = u.program_id AND c.n = u.pl LEFT JOIN cx k ON k.program_id = c.program_id AND k.n = c.p WHERE u.f IS NULL),
        af AS (SELECT program_id, n, f FROM up WHERE f IS NOT NULL),
        lt AS (SELECT c.program_id, c.n, min(d.n) AS later FROM cx c JOIN cx d ON d.program_id = c.program_id AND d.p = c.p AND d.n > c.n AND d.bb <> c.bb WHERE c.cond GROUP BY ALL),
        ins AS (SELECT c.program_id, c.n, CASE WHEN c.cond THEN 'condition' ELSE c.kind END AS kind,
            CASE WHEN c.kind = 'loop' THEN 'node:' || regexp_extract(c.instruction, '^(\\w+) (?:exists|missing|is )', 1) ELSE c.key END AS key,
            CASE WHEN c.kind = 'loop' AND regexp_matches(c.instruction, '^\\w+ (exists$|missing$|is )') THEN regexp_replace(c.instruction, '^\\w+ ', '') ELSE c.instruction END AS said,
            CASE WHEN c.cond THEN CASE WHEN f.p = c.p AND f.b = c.bb THEN c.n + 1 ELSE ap.f END WHEN c.kind = 'if' THEN c.n + 1 WHEN c.kind = 'loop' THEN CASE WHEN f.p = c.n THEN c.n + 1 ELSE c.n END ELSE af.f END AS next,
            CASE WHEN c.cond THEN coalesce(lt.later, ap.f) WHEN c.kind = 'loop' THEN af.f ELSE -1 END AS other
            FROM cx c LEFT JOIN cx f ON f.program_id = c.program_id AND f.n = c.n + 1 LEFT JOIN af ON af.program_id = c.program_id AND af.n = c.n LEFT JOIN af ap ON ap.program_id = c.program_id AND ap.n = c.p LEFT JOIN lt ON lt.program_id = c.program_id AND lt.n = c.n),
        ru(program_id, pc, steps, unknown, held, turns) AS (SELECT DISTINCT program_id, CAST(0 AS BIGINT), 0, 0, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)), CAST(MAP {{}} AS MAP(BIGINT, INTEGER)) FROM cx
            UNION ALL SELECT program_id, CASE WHEN asks AND NOT coalesce(t, false) THEN other ELSE next END, steps + 1, unknown + CASE WHEN asks AND t IS NULL THEN 1 ELSE 0 END,
                CASE WHEN kind = 'create' OR (kind = 'update' AND has) THEN map_concat(without, MAP {{key: said}}) WHEN kind = 'delete' THEN without ELSE held END,
                CASE WHEN kind = 'loop' AND coalesce(t, false) THEN map_concat(others, MAP {{pc: cnt + 1}}) WHEN kind = 'loop' THEN others ELSE turns END
            FROM (SELECT *, CASE WHEN said = 'true' THEN true WHEN said = 'false' THEN false WHEN said = 'exists' THEN has WHEN said = 'missing' THEN NOT has WHEN starts_with(said, 'is ') THEN coalesce(held[key] = said[4:], false)
                    WHEN kind = 'loop' AND regexp_matches(said, '^times [0-9]+$') THEN cnt < CAST(regexp_extract(said, '[0-9]+') AS INTEGER) END AS t
                FROM (SELECT ru.*, i.kind, i.key, i.said, i.next, i.other, i.kind IN ('condition', 'loop') AS asks, list_contains(map_keys(held), i.key) AS has, coalesce(turns[pc], 0) AS cnt,
                        map_from_entries(list_filter(map_entries(held), lambda e: e.key <> i.key)) AS without, map_from_entries(list_filter(map_entries(turns), lambda e: e.key <> pc)) AS others
                    FROM ru JOIN ins i ON i.program_id = ru.program_id AND i.n = ru.pc WHERE pc <> -1 AND steps < 40)))
        SELECT program_id, CASE WHEN pc = -1 THEN 'done' ELSE 'unending' END AS status, steps, unknown, coalesce(array_to_string(list_sort(list_transform(map_entries(held), lambda e: e.key || '=' || e.value)), ';'), '') AS held
        FROM ru WHERE pc = -1 OR steps = 40 UNION ALL SELECT program_id, 'error', NULL, NULL, NULL FROM va WHERE NOT valid""",
    "prompt_check": "SELECT n_nationkey, n_nationkey % 3 = 0 AS ok FROM nation",
}
