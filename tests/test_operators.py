"""Operators against plain versions, and their edge cases."""

import io
import random
import time
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.operators import automaton, deps, dsl, graph, grids, items, match, results, score, tabular, terms
from loam.sources import files, tables


def places(text, term):
    return [i for i in range(len(text)) if text.startswith(term, i)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abA é\n", max_size=40), max_size=4), st.lists(st.text("abA é", max_size=3), max_size=5), st.integers(0, 2))
def test_finder(texts, words, few):
    find = match.Finder([terms.Term(w, k) for k, w in enumerate(words)])
    data = "".join(texts).encode()
    whole, match.FEW_HEADS = match.FEW_HEADS, (64, 0, 0)[few]
    try:
        found = find(np.frombuffer(data, np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in texts], dtype=np.int64)].astype(np.int64))
    finally:
        match.FEW_HEADS = whole
    got = [(d, p, find.terms[t].text, n) for d, t, p, n in zip(found.doc, found.term, found.pos, found.line)]
    expected = [(d, p, w, text[:p].count("\n") + 1) for d, text in enumerate(texts) for w in {*words} - {""} for p in places(text, w)]
    assert got == sorted(expected, key=lambda x: (x[0], x[1] + len(x[2]), -len(x[2]))) or sorted(got) == sorted(expected) and [g[0] for g in got] == sorted(g[0] for g in got)
    assert found.length.tolist() == [len(t) for t in texts]
    assert all(find.terms[t].order == len(words) - 1 - words[::-1].index(find.terms[t].text) for t in found.term)  # the last of equal terms


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab é", min_size=1, max_size=6), min_size=1, max_size=12, unique=True), st.text("abc é\n", max_size=1500), st.integers(1, 60))
def test_automaton(words, text, most):
    """Against a plain search; tables of few entries deal the words to several automata, of which each has one word at least."""
    raw, found, seen = text.encode(), [], []
    encoded = [np.frombuffer(w.encode(), np.uint8) for w in words]
    for own in automaton.grouped(encoded, most):
        word, end = automaton.Automaton([encoded[k] for k in own]).ends(np.frombuffer(raw, np.uint8))
        got = [(e, -encoded[own[w]].size, words[own[w]]) for w, e in zip(word.tolist(), end.tolist())]
        assert got == sorted(got)  # by end, the longest first
        found += got
        seen += own
    assert sorted(seen) == list(range(len(words)))
    assert sorted(found) == sorted((i + len(w.encode()), -len(w.encode()), w) for w in words for i in range(len(raw)) if raw.startswith(w.encode(), i))


def test_many_terms(spark):
    """10,000 terms of a table: every occurrence, and a time that does not follow their number."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 9))) for _ in range(10_000)})
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(60)]
    table = spark.createDataFrame([(w, i % 3) for i, w in enumerate(words)] + [("", 1), (None, 1), (words[0], 9)], "text string, level int")
    asked = terms.from_table(table, order_col="level")
    assert {t.text: t.order for t in asked} == {w: i % 3 for i, w in enumerate(words)}
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    took = {}
    for n in (40, len(asked)):
        find = match.Finder(asked[:n])
        find(data, offsets)
        began = time.perf_counter()
        found = find(data, offsets)
        took[n] = (time.perf_counter() - began) / max(1, len(found.doc) // 100_000)
    known = set(words)
    sizes = sorted({len(w) for w in words})
    want = {(d, p, t[p : p + n]) for d, t in enumerate(texts) for p in range(len(t)) for n in sizes if t[p : p + n] in known}
    assert {(d, p, find.terms[k].text) for d, p, k in zip(found.doc.tolist(), found.pos.tolist(), found.term.tolist())} == want
    assert took[len(asked)] < 8 * took[40]  # 250 times the terms
    with pytest.raises(ValueError):
        terms.from_table(spark.range(2).select(F.repeat(F.concat(F.lit("x"), F.col("id").cast("string")), 20 << 20).alias("text")))


def test_terms():
    assert terms.parse(["a::2", "b", "c::1::3"]) == [terms.Term("a", 2), terms.Term("b"), terms.Term("c")]
    assert terms.grams("abc") == ["abc"] and terms.grams("abcde") == ["abc", "bcd", "cde"] and terms.grams("abcdefgh")[0] == "abcd" and terms.grams("abcdefghi")[0] == "abcde"
    got = terms.expand("Bulgraia energy", correct={"Bulgraia": "Bulgaria"}.get)
    assert got[0] == terms.Term("Bulgraia energy") and got[1] == terms.Term("Bulgaria", 1) and terms.Term("BULGRAIA ENERGY", 1) in got and terms.Term("gari", 2) in got
    assert terms.last_wins([terms.Term("a", 0), terms.Term("", 0), terms.Term("a", 2)]) == [terms.Term("a", 2)]
    assert terms.prepare(["A::1"], ref_ids=["x"]) == [terms.Term("A", 1)]


def plain_score(found, length):
    ps = sorted(p for p, _, _ in found)
    n = c = 0
    first = None
    for p in ps:
        if first is None or p - first > 50:
            c, first = c + 1, p
    n = len(ps)
    share = n / length
    return sum(0.9 / (o + 1) for _, _, o in found) * len({t for _, t, _ in found}) ** 0.5 * (1 + share) * (1 + 1 / c) * (1 + min(1, share))


def test_scores(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("aab cd\n") for _ in range(rng.randint(0, 400)))) for i in range(60)] + [(60, ""), (61, None)]
    asked = [terms.Term("aa", 0), terms.Term("b c", 1), terms.Term("a", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = match.match(docs, asked).select("doc_id", "text", "matches", score.advanced(F.col("matches"), F.length("text")).alias("s"), score.clusters(F.col("matches")).alias("c"), score.advanced(F.col("matches"), F.length("text"), noise=["a"]).alias("quiet")).collect()
    assert len(found) == 62
    for r in found:
        expected = [(p, t.text, t.order) for t in asked for p in places(r["text"] or "", t.text)]
        assert sorted((m["pos"], m["term"], m["order"]) for m in r["matches"]) == sorted(expected)
        assert all(m["line"] == 1 + r["text"][: m["pos"]].count("\n") for m in r["matches"])
        assert r["s"] == pytest.approx(plain_score(expected, len(r["text"])) if expected else 0.0)
        only = [x for x in expected if "a" not in x[1]]
        assert r["quiet"] == pytest.approx(plain_score(only, len(r["text"])) if only else 0.0)


def test_contexts(spark):
    text = "\n".join(f"line {i}" + (" hit" if i in (2, 3, 9) else "") for i in range(1, 12))
    docs = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id int, text string")
    r = results.bulk_search(docs, [terms.Term("hit")], context=1, min_score=0.0).collect()
    assert len(r) == 1 and r[0]["line_numbers"] == [2, 3, 9] and r[0]["search_term_match_counts"] == {"hit": 3}
    assert r[0]["matches_with_context"] == ["|1|    line 1\n|2|    line 2 hit\n|3|    line 3 hit\n|4|    line 4", "|8|    line 8\n|9|    line 9 hit\n|10|    line 10"]
    assert r[0]["title"].startswith("line 1\n") and r[0]["title"].count("\n") == 4
    assert results.search(docs, [terms.Term("hit"), terms.Term("line")], all_terms=True, min_score=0.0).count() == 1
    assert results.search(docs, [], min_score=0.0).count() == 0


def test_items(spark):
    block = spark.createDataFrame([("f", 0, "aa\r\nbbb\r\nc")], "file_id string, block_id long, text string")
    ix = items.split_block(block).orderBy("item").collect()
    assert [(r["item"], r["start"], r["end"], r["content"]) for r in ix] == [(1, 0, 4, "aa"), (2, 4, 9, "bbb"), (3, 9, 12, "c")]
    at = spark.createDataFrame([("f", 0, p) for p in (0, 3, 4, 8, 11, 12)], "file_id string, block_id long, pos long")
    half = items.positions_to_items(at, items.split_block(block)).collect()
    assert sorted((r["pos"], r["item"]) for r in half) == [(0, 1), (3, 1), (4, 2), (8, 2), (11, 3)]
    both = items.positions_to_items(at, items.split_block(block), inclusive=True).collect()
    assert sorted((r["pos"], r["item"]) for r in both) == [(0, 1), (3, 1), (4, 1), (4, 2), (8, 2), (11, 3), (12, 3)]


def test_items_with_raw_breaks(spark):
    """Breaks that no valid start follows belong to the item; numbers, offsets and lookups after it stay right."""
    texts = ["r1,u7,fine\r\n\r\nr2 is no start", "r22,u8,x\r\n", "r3,u9,last\r\ntext"]
    block = spark.createDataFrame([("f", 0, "\r\n".join(texts) + "\r\n"), ("f", 1, texts[1] + "\r\n" + texts[0])], "file_id string, block_id long, text string")
    ix = items.split_block(block, begin=r"r\d+,u\d+,")
    got = {b: [(r["item"], r["start"], r["end"], r["content"]) for r in ix.where(f"block_id = {b}").orderBy("item").collect()] for b in (0, 1)}
    assert got == {0: [(1, 0, 30, texts[0]), (2, 30, 42, texts[1]), (3, 42, 60, texts[2])], 1: [(1, 0, 12, texts[1]), (2, 12, 42, texts[0])]}
    at = spark.createDataFrame([("f", 0, p) for p in (14, 29, 30, 59)], "file_id string, block_id long, pos long")
    assert sorted((r["pos"], r["item"]) for r in items.positions_to_items(at, ix).collect()) == [(14, 1), (29, 1), (30, 2), (59, 3)]


def test_graph(spark):
    nodes = spark.createDataFrame([("A", "x", {"p": "1"}), ("B", "y", {})], graph.NODES)
    edges = spark.createDataFrame([("A", "B", "e", {})], graph.EDGES)
    new = spark.createDataFrame([("B", "A", "e", {}), ("A", "C", "e", {})], graph.EDGES)
    kept, wrong = graph.add_edges(nodes, edges, new)
    assert kept.count() == 2 and [(r["source"], r["target"]) for r in wrong.collect()] == [("A", "C")]
    change = spark.createDataFrame([("A", {"p": "2", "q": "3"}), ("Z", {"p": "0"})], "uid string, props map<string,string>")
    assert {r["uid"]: r["props"] for r in graph.update(nodes, change, ["uid"]).collect()} == {"A": {"p": "2", "q": "3"}, "B": {}}
    assert [r["uid"] for r in graph.missing(nodes, change, ["uid"]).collect()] == ["Z"]
    left, other, gone = graph.remove_nodes(nodes, edges, spark.createDataFrame([("A",)], "uid string"))
    assert left.count() == 1 and other.count() == 0 and gone.count() == 1
    shots = graph.snapshot(nodes, 1, "m", F.lit("t"))
    assert sorted(r["uid"] for r in graph.rollback(shots, 1).collect()) == ["A", "B"]
    lone = spark.createDataFrame([("A", "x", {})], graph.NODES)
    assert graph.centrality(lone, edges.where("false")).first()["centrality"] == 1.0


def test_language(spark):
    good = 'C► NODE a "x" ◄ IF► E► LINK l "q" ◄ D► NODE b "y" ◄ ELIF► N► 3.5 "z" ◄ ELSE► U► NODE a "w" ◄ ◄ LOOP► "again" ◄ C► NODE c "é\\n" ◄ ◄'
    bad = ('C► NODE a "x"', "END►", 'C► THING a "x" ◄', "§", 'IF► E► LINK l "q" ◄', "◄", 'LOOP► "a" ◄ ELSE► N► "b" ◄ ◄', 'IF► N► "a" ◄ ELSE► ELSE► ◄', 'IF► LOOP► "a" ◄ ◄ ◄', 'ELIF► N► "b" ◄')
    said = [(1, good), (2, None), (3, ""), (4, " \n"), *enumerate(bad, 10)]
    programs = spark.createDataFrame(said, "program_id long, text string")
    trees = dsl.syntax_trees(programs).orderBy("program_id", "node_id").collect()
    rows = [r for r in trees if r["program_id"] == 1]
    assert [r["kind"] for r in rows] == ["create", "if", "evaluate", "delete", "navigate", "update", "loop", "create"]
    assert rows[4]["timeout"] == "3.5" and rows[4]["branch"] == "elif0_condition" and rows[7]["instruction"] == "é\n" and rows[7]["parent_id"] == 6
    assert sorted(r["program_id"] for r in trees if r["kind"] == "error") == [n for n, _ in said if n >= 10] and not any(r["program_id"] in (2, 3, 4) for r in trees)
    assert {r["program_id"]: r["valid"] for r in dsl.validity(programs).collect()} == {n: n < 10 for n, _ in said}
    tokens = dsl.tokens_of(spark.createDataFrame([(1, 'N► 5 "é" x'), (2, "a é"), (3, None)], "program_id long, text string")).orderBy("program_id", "seq").collect()
    assert [(r["type"], r["value"], r["pos"]) for r in tokens] == [("KEYWORD", "N►", 0), ("NUMBER", "5", 3), ("STRING", '"é"', 5), ("IDENT", "x", 9), ("ERROR", "unexpected character 'é' at 2", -1)]
    deep, long = "".join(f'LOOP► "{n}" ◄ ' for n in range(60)) + "◄" * 60, 'C► NODE a "' + "x\\n" * 20000 + '" ◄ '
    large = dsl.syntax_trees(spark.createDataFrame([(1, deep), (2, long * 5)], "program_id long, text string")).collect()
    assert sorted((r["program_id"], r["parent_id"]) for r in large) == [(1, n) for n in range(-1, 59)] + [(2, -1)] * 5
    base = spark.createDataFrame([("a", "old", {"k": "v"}), ("k", "old", {})], graph.NODES)
    steps = spark.createDataFrame([(1, 'D► NODE a "" ◄ U► NODE a "lost" ◄ C► NODE n "1" ◄ U► NODE n "2" ◄ U► NODE k "3" ◄')], "program_id long, text string")
    got = {r["uid"]: (r["type"], r["props"]) for r in dsl.apply_commands(base, dsl.syntax_trees(steps)).collect()}
    assert got == {"n": ("node", {"instruction": "2"}), "k": ("old", {"instruction": "3"})}


def test_grids(spark):
    g = [[1, 0, 2], [0, 1, 2], [0, 0, 0]]
    rows = spark.createDataFrame([("t", g), ("z", [[0, 0]])], "key string, grid array<array<int>>")
    s = grids.shapes(rows).collect()
    assert [(r["color"], r["size"], r["x"], r["y"], r["subgrid"]) for r in s] == [(1, 2, 0, 2, [[1, 0], [0, 1]]), (2, 2, 2, 2, [[2], [2]])]
    texts = {r["key"]: r["t"] for r in rows.select("key", grids.compact_text(grids.crop(F.col("grid"))).alias("t")).collect()}
    assert texts == {"t": "102\n012", "z": "00"}
    pos = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("c", 2, 2), ("c", 2, 2)], "key string, x int, y int")
    want = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 0, 1), ("c", 2, 2), ("c", 2, 2), ("d", 0, 0)], "key string, x int, y int")
    assert {r["key"]: r["reason"] for r in grids.evaluate(pos, want).collect()} == {"a": "", "b": "position", "c": "duplicate", "d": "count"}
    said = spark.createDataFrame([("r", "SHAPE 1\nPOS: 3,4\n\nDescription: big\n\n010\n000\n\nSHAPE 2\n\nPOS: 5,6\n\nno grid")], "key string, text string")
    assert [(r["x"], r["y"], r["description"]) for r in grids.parse_responses(said).collect()] == [(0, 0, "Description: big")]
    assert [(r["x"], r["y"]) for r in grids.parse_responses(said, strict=False).collect()] == [(3, 4)]
    one = spark.createDataFrame([("abcd", "bcde"), ("", "")], "a string, b string").select(grids.similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in one] == [0.75, 1.0]


def test_dependencies(spark):
    f = spark.createDataFrame([(p,) for p in ("pkg/__init__.py", "pkg/a.py", "pkg/sub/b.py", "tools/run.py", "Helper.py")], "path string")
    assert {r["module"]: r["path"] for r in deps.module_mapping(f).collect()}["pkg"] == "pkg/__init__.py"
    src = [("pkg/a.py", "import os, pkg.sub.b\nfrom .sub.b import x\nimport helper\nimport nowhere"), ("bad.py", "import ("), ("none.py", None)]
    found = deps.imports(spark.createDataFrame(src, "path string, text string"), {"os"})
    got = {r["module"]: r["target"] for r in deps.resolve(found, f).collect()}
    assert got == {"pkg.sub.b": "pkg/sub/b.py", "sub.b": "pkg/sub/b.py", "helper": "Helper.py", "nowhere": None}
    assert deps.edges(deps.resolve(found, f)).count() == 2
    clusters = deps.directory_clusters(f, 2).collect()
    assert len({r["cluster"] for r in clusters}) == 2 and len(clusters) == 5


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("é\nb", encoding="utf-8")
    (tmp_path / "in/l.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "in/x.bin").write_bytes(b"\0")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "in/d.docx").write_bytes(buffer.getvalue())
    got = {r["uri"].rsplit("/", 1)[1]: (r["text"], r["is_utf8"]) for r in files.documents(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": ("é\nb", True), "l.txt": ("é", False), "x.bin": (None, False), "d.docx": ("one\ntwo", True)}
    assert files.directory_sizes(files.listing(spark, str(tmp_path / "in"))).first()["n"] == 4
    (tmp_path / "t").mkdir()
    (tmp_path / "t/ok.json").write_text('{"train":[{"input":[[1]],"output":[[2]]}],"test":[{"input":[[3,4]]}]}')
    (tmp_path / "t/no.json").write_text('{"train":[],"test":[{"input":[[3]]}]}')
    t = files.tasks(spark, str(tmp_path / "t")).collect()
    assert {(r["task_id"], r["split"], r["role"], str(r["grid"])) for r in t} == {("ok", "train", "input", "[[1]]"), ("ok", "train", "output", "[[2]]"), ("ok", "test", "input", "[[3, 4]]"), ("ok", "test", "output", "[[0, 0]]")}


def test_tables(spark, tmp_path):
    root = str(tmp_path / "v")
    assert tables.versions(spark, root) == []
    assert tables.commit(spark.range(2), root) == 1 and tables.commit(spark.range(5), root) == 2
    assert tables.load(spark, root).count() == 5 and tables.load(spark, root, 1).count() == 2
    with pytest.raises(ValueError):
        tables.load(spark, root, 9)


def test_stream(spark, tmp_path):
    from loam.streaming import audit

    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:20:00", "a"), (3, "2024-01-01 02:00:00", "b")], "id int, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        audit.append(audit.changes(spark, str(tmp_path / "in"), "id int, ts timestamp, kind string"), "seen", "id", "ts", str(tmp_path / "log"), str(tmp_path / "c"), kind=F.col("kind")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    assert sorted((r["kind"], r["n"]) for r in audit.activity(rows, "ts", "kind").collect()) == [("a", 2), ("b", 1)]


def test_tabular(spark):
    empty = spark.createDataFrame([], "x int")
    assert tabular.success_rate(empty, F.col("x") == 1).first()["rate"] == 0.0


def test_fields(spark):
    """Quoted fields of any length, with doubled quotes, commas and line ends, as the standard reader of delimited text has them."""
    import csv

    rows = ["a,b,c", "", ",", '"x"', '"","",', 'k,"' + 'long, "" text\r\n' * 8000 + '",z', '"' + '""' * 30_000 + '",é', "x" * 120_000 + ",y", ",".join(["1"] * 3000)]
    got = items.fields(spark.createDataFrame(list(enumerate(rows)), "i int, content string"), ["one"]).orderBy("i").collect()
    for r, text in zip(got, rows):
        want = next(csv.reader(io.StringIO(text, newline="")), [""])
        assert [f["value"] for f in r["fields"]] == want and [f["name"] for f in r["fields"]] == ["one", *(f"Column {k}" for k in range(2, len(want) + 1))]


def test_sizes_as_c_prints_them(spark):
    """Decimals of the exact value, halves to the even digit; sizes above 2^53 are those of their doubles."""
    from loam.functions.text import size_text

    sizes = [0, 1, 1023, 1024, 1152, 1280, 5 * 128 + 1024, 1048571, 1048575, 1048576, (1 << 20) + (1 << 17), (1 << 30) - 1, 1 << 30, 5 * (1 << 27), 9 * (1 << 27), 20000**3, 1199999**3, (1 << 62) + 3, *(n**3 for n in range(11, 4000, 7)), *(1024 + 128 * n for n in range(900))]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", size_text(F.col("n")).alias("t")).collect()
    unit = lambda n: next((n / u, k) for u, k in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")) if n < u << 10 or k == "GB")
    assert {r["n"]: r["t"] for r in rows} == {n: f"{n} B" if n < 1024 else "%.2f %s" % unit(float(n)) for n in sizes}


def test_entries_round_halves_up(spark):
    """Sizes of a listing against its SQL, which rounds before it prints: 9856 bytes are 9.63 KB, not 9.62."""
    import duckdb

    from loam.sources import files

    sizes = [9856, 0, 1023, 1048575, 1048576, (1 << 20) + (1 << 17), *(1024 + 128 * n for n in range(120)), *((1 << 20) + 131072 * n + 8 for n in range(60)), *((1 << 20) + 131072 * n for n in range(60))]
    got = files.entries(spark.createDataFrame([(f"d/{i:03}", n) for i, n in enumerate(sizes)], "path string, length long")).collect()
    sql = "SELECT CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', round(n / 1024.0::DOUBLE, 2)) ELSE printf('%.2f MB', round(n / 1048576.0::DOUBLE, 2)) END FROM (SELECT unnest(?) AS n)"
    assert [r["size"] for r in got] == [r[0] for r in duckdb.execute(sql, [sizes]).fetchall()]


def test_line_starts_of_large_batches(spark):
    """Starts whatever the blocks that bytes are counted in, and rows that are told a few MB at a time, not a batch."""
    import tracemalloc

    from loam.functions.arrow import flat
    from loam.sources import files

    rng = random.Random(2)
    for block in (1, 2, 3, 7, 64):
        for _ in range(20):
            texts = ["".join(rng.choice("aé\n𝄞\n") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
            assert files.starts_of_lines(*flat(pa.array(texts)), block).to_pylist() == [[0, *(i + 1 for i, c in enumerate(t) if c == "\n")] for t in texts]
    tasks = []
    frame = spark.createDataFrame([], "doc_id long, text string")
    kept, type(frame).mapInArrow = type(frame).mapInArrow, lambda self, task, schema: tasks.append(task) or self
    try:
        files.line_starts(frame)
    finally:
        type(frame).mapInArrow = kept
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["line of text\n" * 20_000] * 100)], names=["doc_id", "text"])  # 26 MB
    tracemalloc.start()
    told = sum(len(x) for x in tasks[0](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == 100 and most < 100e6


def test_grids_cost_a_digest_and_a_box_each(spark, tmp_path):
    """A part's digest is taken once, not in the lambda of its cells, by all cores; a crop finds its box once, outside the lambda of its rows."""
    from loam.plans import structures

    spark.createDataFrame([(k, f"part {k}") for k in range(50)], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = structures.grids(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and not any("sha2(" in x and "lambdafunction" in x for x in plan.splitlines())
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert made.select(grids.crop(F.col("grid")).alias("t"))._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 1


def test_block_search_scores_a_block_once(spark):
    """Items are matched in one pass and get their block's share and clusters, which no join computes again for each item."""
    rows = spark.createDataFrame([("f", k // 50, k, f"item {k} word" + " term" * (k % 3)) for k in range(200)], "file_id string, block_id long, seq long, content string")
    found = items.search_items(items.index(rows), [terms.Term("term"), terms.Term("word", 1)], 0.5, whole_block=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    got = {(r["block_id"], r["item"]): r["n"] for r in found.collect()}
    assert got == {(k // 50, k % 50 + 1): 1 + k % 3 for k in range(200)}
