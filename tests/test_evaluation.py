"""Evaluation of linked nodes, programs' escapes, commits of several tables and hooks."""

import codecs
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from loam.operators import dsl, evaluation, programs
from loam.sources import tables
from loam.streaming import audit

LINKS = "source string, target string, relation string"


def plain_levels(nodes, links):
    into = {n: {s for s, t, r in links if t == n and s in nodes and r in ("parameter", "eval_sequence")} for n in nodes}
    level, k = {}, 0
    while True:
        ready = [n for n in nodes if n not in level and all(s in level for s in into[n])]
        if not ready:
            return level, into
        level |= dict.fromkeys(ready, k)
        k += 1


def test_levels_and_results(spark):
    rng = random.Random(2)
    nodes = [f"n{i:02}" for i in range(40)]
    links = [(nodes[a], nodes[b], rng.choice(("parameter", "eval_sequence", "hierarchy"))) for a, b in (sorted(rng.sample(range(30), 2)) for _ in range(60))]
    links += [(nodes[30], nodes[31], "parameter"), (nodes[31], nodes[32], "parameter"), (nodes[32], nodes[30], "eval_sequence"), (nodes[32], nodes[33], "parameter"), (nodes[34], nodes[34], "parameter")]
    links += [links[0], ("absent", nodes[1], "parameter"), (nodes[1], "absent", "parameter"), (None, nodes[2], "parameter")]
    level, into = plain_levels(nodes, links)
    op = {n: rng.choice([*evaluation.OPERATIONS, "unknown"]) for n in nodes}
    value = {n: rng.choice([1.0, 2.0, 5.0, None]) for n in nodes}
    results = {}
    for n in sorted(level, key=level.get):
        given = [results[s] for s in into[n] if (s, n, "parameter") in links and results[s] is not None]
        own = value[n]
        if op[n] == "unknown":
            results[n] = None
        elif not given:
            results[n] = own
        else:
            some = given + ([own] if own is not None else [])
            results[n] = {"sum": sum(some), "least": min(some), "greatest": max(some), "mean": sum(given) / len(given), "count": float(len(given))}[op[n]]
    frame = spark.createDataFrame([(n, op[n], value[n], 5.0) for n in nodes], "uid string, op string, value double, target double")
    edges = spark.createDataFrame(links, LINKS)
    assert {r["uid"]: (r["level"], r["cyclic"]) for r in evaluation.levels(frame, edges).collect()} == {n: (level.get(n), n not in level) for n in nodes}
    assert {nodes[k] for k in (30, 31, 32, 33, 34)} <= {n for n in nodes if n not in level}
    got = {r["uid"]: r for r in evaluation.evaluate(frame, edges).collect()}
    assert {n: r["result"] for n, r in got.items()} == {n: pytest.approx(results[n]) if results.get(n) is not None else None for n in nodes}
    assert all((r["weight"] == (1.0 if r["result"] == 5.0 else -1.0)) if n in level else r["weight"] is None for n, r in got.items())
    start = spark.createDataFrame([(nodes[30],), (nodes[30],)], "uid string")
    assert {r["uid"] for r in evaluation.triggered(edges, start).collect()} == {nodes[k] for k in (30, 31, 32, 33)}
    assert evaluation.evaluate(frame.where("false"), edges).count() == 0 and evaluation.levels(frame, edges.where("false")).where("level = 0").count() == 40


def test_unquote(spark):
    texts = [r"plain", r"a\nb\tc\r", r"\x41\x7a\xe9", r"é日", r"\U0001F600!", r"\101\7\1234", r"\q\\n", r"é日\"x\"", r"\x4", "\\a\\b\\f\\v", "line\\\nend"]
    got = spark.createDataFrame([(f'"{t}"',) for t in texts], "s string").select(dsl.unquote(F.col("s")).alias("t")).collect()
    kept = {r"\q\\n": r"\q\n", r"\x4": r"\x4"}  # an unknown escape stays, an unfinished one too
    want = [kept.get(t) or codecs.decode(t.encode("ascii", "backslashreplace"), "unicode_escape") for t in texts]
    assert [r["t"] for r in got] == want
    odd = spark.createDataFrame([(r'"\ud83d!"',), (r'"😀"',), (None,)], "s string").select(dsl.unquote(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in odd] == ["�!", "😀", None]


def test_one_commit(spark, tmp_path):
    root = str(tmp_path / "g")
    frames = lambda k: {name: spark.range(k).withColumn("of", F.lit(k)) for name in ("nodes", "edges", "snapshots")}
    with pytest.raises(ValueError):
        tables.load_all(spark, root)
    assert tables.commit_all(frames(2), root) == 1
    outcome = {}

    def write(k):
        try:
            outcome[k] = tables.commit_all(frames(k), root, based_on=1)
        except tables.Conflict as e:
            outcome[k] = str(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in (3, 4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(map(str, outcome.values()))[0] == "2" and sum(v == 2 for v in outcome.values()) == 1  # the other is refused
    won = next(k for k, v in outcome.items() if v == 2)
    number, found = tables.load_all(spark, root)
    assert number == 2 and {r["of"] for df in found.values() for r in df.select("of").distinct().collect()} == {won}
    assert len(list((tmp_path / "g" / "data").iterdir())) == 2  # the refused writer's folders are gone
    assert tables.load_all(spark, root, 1)[1]["nodes"].count() == 2  # a reader of an earlier commit keeps it
    with pytest.raises(tables.Conflict):
        tables.commit_all(frames(5), root, based_on=1)
    (tmp_path / "g" / "_commits" / "3.json").write_text('{"nodes"')  # a writer that stopped
    assert tables.latest(spark, root) == 2 and tables.load_all(spark, root)[0] == 2
    with pytest.raises(tables.Conflict, match="3"):
        tables.commit_all(frames(6), root)


def test_graph_commits(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "t", {"k": "v"})], "uid string, type string, props map<string,string>")
    edges = spark.createDataFrame([], "source string, target string, type string, props map<string,string>")
    assert tables.save_graph(nodes, edges, spark.range(1), str(tmp_path)) == 1
    n, e, s = tables.load_graph(spark, str(tmp_path))
    assert (n.count(), e.count(), s.count()) == (1, 0, 1)
    assert tables.save_graph(n.limit(0), e, s, str(tmp_path), based_on=1) == 2  # made from what it replaces
    assert tables.load_graph(spark, str(tmp_path))[0].count() == 0 and tables.load_graph(spark, str(tmp_path), 1)[0].count() == 1


def test_hooks(spark, tmp_path):
    """Hooks get their events' rows once across restarts; what fails is told in a table and stops nothing."""
    schema = "event string, key string"
    seen = []
    hooks = {"add": lambda rows: seen.extend(r["key"] for r in rows.collect()), "drop": lambda rows: 1 / rows.count() and seen.append("dropped"), "odd": lambda rows: [][1]}
    run = lambda: audit.hooked(audit.changes(spark, str(tmp_path / "in"), schema), hooks, str(tmp_path / "c"), str(tmp_path / "errors")).awaitTermination()
    for part in ([("add", "a"), ("drop", "b")], [("add", "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    run()  # a restart without new rows
    assert sorted(seen) == ["a", "c", "dropped"]
    errors = spark.read.parquet(str(tmp_path / "errors")).select("event", "batch").collect()
    assert sorted(map(tuple, errors)) == [("drop", 1), ("odd", 0), ("odd", 1)]


def run_tree(rows, most):
    """A program's tree, walked: (status, steps, unknown, held)."""
    held, state = {}, {"steps": 0, "unknown": 0}

    class Ended(Exception):
        pass

    def tick():
        if state["steps"] == most:
            raise Ended
        state["steps"] += 1

    def holds(key, said, turn=None):
        if said in ("true", "false"):
            return said == "true"
        if said in ("exists", "missing"):
            return (key in held) == (said == "exists")
        if said.startswith("is "):
            return held.get(key) == said[3:]
        if turn is not None and re.fullmatch(r"times \d{1,9}", said):
            return turn < int(said[6:])
        state["unknown"] += 1
        return False

    def block(parent, branch):
        for r in sorted((r for r in rows if r["parent_id"] == parent and r["branch"] == branch), key=lambda r: r["seq"]):
            key = f"{(r['entity'] or '').lower()}:{r['uid']}"
            if r["kind"] == "if":
                tick()
                for b in ["if", *(f"elif{k}" for k in range(9))]:
                    c = [x for x in rows if x["parent_id"] == r["node_id"] and x["branch"] == f"{b}_condition"]
                    if not c:
                        block(r["node_id"], "else")
                        break
                    tick()
                    if holds(f"{c[0]['entity'].lower()}:{c[0]['uid']}", c[0]["instruction"]):
                        block(r["node_id"], b)
                        break
            elif r["kind"] == "loop":
                m, turn = re.fullmatch(r"(\w+) (exists|missing|is .*)", r["instruction"], re.S), 0
                while True:
                    tick()
                    if not holds(f"node:{m[1]}" if m else "", m[2] if m else r["instruction"], turn):
                        break
                    turn += 1
                    block(r["node_id"], "loop")
            else:
                tick()
                if r["kind"] == "create" or r["kind"] == "update" and key in held:
                    held[key] = r["instruction"]
                elif r["kind"] == "delete":
                    held.pop(key, None)

    try:
        block(-1, "top")
        return "done", state["steps"], state["unknown"], held
    except Ended:
        return "unending", state["steps"], state["unknown"], held


def test_programs(spark):
    """Random programs against a walk of their trees; one that is not valid, an empty one, and one that does not end."""
    rng = random.Random(12)
    uid = lambda: rng.choice("abc")
    condition = lambda: rng.choice(["exists", "missing", "is 1", "is 2", "true", "false", "odd"])

    def text(depth):
        out = []
        for _ in range(rng.randint(0 if depth < 3 else 1, 3)):
            kind = rng.choice("CUDNILL" if depth else "CUDN")
            if kind in "CUD":
                out.append(f'{kind}► {rng.choice(("NODE", "LINK"))} {uid()} "{rng.randint(1, 2)}" ◄')
            elif kind == "N":
                out.append('N► "go" ◄')
            elif kind == "I":
                elifs = "".join(f' ELIF► E► NODE {uid()} "{condition()}" ◄ {text(depth - 1)}' for _ in range(rng.randint(0, 2)))
                other = f" ELSE► {text(depth - 1)}" if rng.random() < 0.5 else ""
                out.append(f'IF► E► NODE {uid()} "{condition()}" ◄ {text(depth - 1)}{elifs}{other} ◄')
            else:
                said = rng.choice([f"times {rng.randint(0, 3)}", f"{uid()} missing", f"{uid()} is 2", "false", "times x"])
                out.append(f'LOOP► "{said}" ◄ {text(depth - 1)} ◄')
        return " ".join(out)

    texts = [text(3) for _ in range(120)] + ['LOOP► "true" ◄ N► "on" ◄ ◄', 'LOOP► "true" ◄ ◄', 'IF► E► NODE a "x"', ""]
    trees = dsl.syntax_trees(spark.createDataFrame(list(enumerate(texts)), "program_id long, text string")).cache()
    rows = {}
    for r in trees.collect():
        rows.setdefault(r["program_id"], []).append(r)
    got = {r["program_id"]: (r["status"], r["steps"], r["unknown"], r["held"]) for r in programs.execute(trees, 60).collect()}
    trees.unpersist()
    assert got.keys() == rows.keys() and got[122] == ("error", None, None, None) and got[120][0] == "unending"
    for p, own in rows.items():
        if p != 122:
            assert got[p] == run_tree(own, 60), texts[p]
    assert len({v[0] for v in got.values()}) == 3 and sum(v[1] or 0 for v in got.values()) > 600
