"""Fill-in-middle, collocations and the rule ensemble against plain versions, round trips and held-out labels."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import collocations as C
from loam.llm import fill_middle as M
from loam.llm import quality as Q
from loam.llm.catalog import queries

SF = "/root/testdata/sf0.01"


def plain_fim(d, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def some_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "bc", "<", "P", "<P>", "S>", "M", "é", "日", "1", " ", "\n"]) for _ in range(rng.randint(0, 700))) for _ in range(n)]


def test_scan_is_associative():
    """The functions of parts of a text, wherever it is cut, compose to its own; places are found from any entry state."""
    rng = random.Random(5)
    scan = lambda parts: M.Scan(np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])])
    for text in some_texts(3, 30):
        raw = text.encode()
        end, count = scan([raw]).whole()
        assert count[0, 0] % M.MARKER == len(re.findall("[A-Za-z]+|[^A-Za-z]", text)) and count[0, 0] // M.MARKER == len(re.findall("<[PSM]>", text))
        at = sorted(rng.randint(0, len(raw)) for _ in range(3))
        ends, counts = scan([raw[a:b] for a, b in zip([0, *at], [*at, len(raw)])]).whole()
        f = ends[:1], counts[:1]
        for k in range(1, len(ends)):
            f = M.compose(f, (ends[k : k + 1], counts[k : k + 1]))
        assert (f[0] == end).all() and (f[1] == count).all()
        inside = scan([raw])
        if raw[:1].isalpha() and count[0, 1]:  # entered in letters, the first run goes on
            assert count[0, 1] == count[0, 0] - 1
            assert inside.places(np.array([0]), np.array([1]), np.array([0]))[0] == len(re.match("[A-Za-z]+", text)[0])


@pytest.mark.parametrize("giant", [8 << 20, 150])
def test_fill_in_middle(spark, awkward, nothing, giant):
    rows = [*awkward, *((300 + i, t) for i, t in enumerate(some_texts(4, 60))), (None, "no id, some words"), (None, None), (3, awkward[3][1]), (3, "another text of that id"), (4, "y" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("n", "form", "h1", "digest", "output")))
    made = M.fill_in_middle(docs, giant_bytes=giant, part_bytes=40).select("*", M.restored(F.col("output"), F.col("form")).alias("back"))
    got = Counter(tuple(r) for r in made.collect())
    want = Counter((d, *plain_fim(d, t), t or "") for d, t in rows)
    assert got == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(nothing, giant_bytes=giant).count() == 0


def plain_collocations(rows, longest=4, least=30, covered=80, most=2000):
    count, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                count.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        kept = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        found = []
        for g, a in kept.items():
            if any(covered * a <= 100 * n and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, n in kept.items() if len(x) > len(g)):
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, words[lang], -score))
    return sorted(out)


def test_collocations(spark, awkward, nothing):
    rng = random.Random(8)
    some = ["The", "of", "x", "Ümlaut", "ÜX", "日本", "a-b", "q\x00"]
    texts = [" ".join(rng.choice(some) + rng.choice(["", "", "", ",", "\t", "  ", "!\n", "\x0b", "\x85"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(("de", "en", None, "und", "a b")[i % 5], t) for i, t in enumerate(texts)] + [("en", "x of x of x of x of"), ("en", None), ("de", " \t "), (None, "one line again and again.\n" * 40)] + [("en", t) for _, t in awkward if t is None or len(t) < 5000]
    docs = spark.createDataFrame([(x, t, "z", "z") for x, t in rows], "lang string, text string, phrase string, n string")
    for how in ({"least": 4}, {"least": 3, "longest": 3, "most": 7, "covered": 50}, {"least": 5, "longest": 2}):
        got = sorted(tuple(r) for r in C.collocations(docs, **how).collect())
        assert got == plain_collocations(rows, **how) and got
    assert C.collocations(nothing.withColumn("lang", F.lit("en"))).count() == 0
    with pytest.raises(ValueError):
        C.collocations(docs, longest=1)


def test_collocations_of_large_counts(spark):
    """Products of more than 64 bits stay exact."""
    n = 9 * 10**17
    counts = spark.createDataFrame([(n, n // 3, n // 7)], "a long, l long, r long")
    score = counts.select(F.expr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))").alias("s")).first()["s"]
    assert score == 2000000 * n // (n // 3 + n // 7)


def test_collocations_spill(spark, monkeypatch):
    """Buckets are streamed: the memory of duckdb may be far below what they hold."""
    monkeypatch.setattr(C, "BUCKET_MEMORY", "16MB")
    docs = spark.range(0, 400, 1, 4).select(F.lit("en").alias("lang"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.pmod(F.xxhash64(i, F.col("id") % 12), F.lit(5000)).cast("string"))).alias("text"))
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r) for r in C.collocations(docs).collect()) == plain_collocations(rows)


def plain_statistics(text):
    share = lambda a, b: a / b if b else 0.0
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
    words = re.findall("[^ \t-\r]+", text)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    symbol = lambda c: 32 < ord(c) < 127 and not c.isalnum() and c not in ".,;:?'\"-()!"
    n = len(text)
    letters, of = sum(map(letter, text)), len(words)
    counts = Counter(low)
    return [
        math.log1p(n), share(letters, n), share(sum("A" <= c <= "Z" for c in text), letters), share(sum("0" <= c <= "9" for c in text), n), share(sum(map(symbol, text)), n), share(sum(c in ".,;:?'\"-()" for c in text), n), share(text.count("!"), n),
        math.log1p(of), share(sum(map(len, words)), of), share(sum(len(w) <= 3 for w in words), of), share(sum(not any(map(letter, w)) for w in words), of), share(sum(symbol(w[-1]) for w in words), of), share(sum("A" <= w[0] <= "Z" for w in words), of),
        share(sum(a == b for a, b in zip(low, low[1:])), of), share(len(counts), of), share(max(counts.values(), default=0), of), math.log1p(len(lines)), share(of, len(lines)), share(len(set(lines)), len(lines)),
    ]


def test_statistics(frame, awkward, nothing):
    got = {r["doc_id"]: list(r)[1:] for r in Q.statistics(frame).collect()}
    assert got.keys() == dict(awkward).keys()
    for d, t in awkward:
        assert got[d] == pytest.approx(plain_statistics(t or ""), abs=1e-9), d
    assert Q.statistics(nothing).count() == 0


def test_rules():
    tree = """RandomForestClassificationModel: uid=x, depth=2
  If (feature 1 <= 0.5)
   If (feature 2 <= 1.5E-4)
    Predict: 0.0
   Else (feature 2 > 1.5E-4)
    Predict: 1.0
  Else (feature 1 > 0.5)
   If (feature 1 <= 0.75)
    Predict: 0.0
   Else (feature 1 > 0.75)
    Predict: 1.0
"""
    inf = math.inf
    b = [r.bounds for r in Q.rules_of(tree, ("a", "b", "c"))]
    assert b == [(("b", -inf, 0.5),), (("b", -inf, 0.5), ("c", -inf, 1.5e-4)), (("b", -inf, 0.5), ("c", 1.5e-4, inf)), (("b", 0.5, inf),), (("b", 0.5, 0.75),), (("b", 0.75, inf),)]


def test_quality(spark, awkward, nothing):
    """Held-out labels are told apart; the compiled column is the sum of its rules; held-out labels change nothing."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in queries()["op13_quality"](spark, SF).collect()}
    assert len(got) == docs.count()
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert len(good) > 50 and len(bad) > 5 and sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    learnt = labels.where(~Q.held_out()).select("doc_id", F.col("quality").alias("label"))
    found = Q.statistics(docs)
    model = Q.fit(found.join(learnt, "doc_id"))
    assert 0 < len(model.weights) < 60
    for r in found.withColumn("score", model.score()).limit(100).collect():
        z = model.base + sum(w for rule, w in model.weights if all(low < r[s] <= high for s, low, high in rule.bounds))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)))
    other = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in Q.quality(docs, other, ~Q.held_out()).collect()}
    first = {r["doc_id"]: r["score"] for r in Q.quality(docs, labels, ~Q.held_out()).collect()}
    assert again == pytest.approx(first, abs=0.05)
    odd = spark.createDataFrame([*awkward, (None, "x"), (3, "y"), (3, "y")], "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("label", F.lit(3))
    for told, want in ((labels.limit(0), 0.5), (spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None), (5, 7)], "doc_id long, quality int"), 0.75)):
        scores = [r["score"] for r in Q.quality(odd, told, F.lit(True)).collect()]
        assert len(scores) == len(awkward) + 3 and set(map(lambda s: round(s, 9), scores)) == {want}
    assert Q.quality(nothing, labels, ~Q.held_out()).count() == 0


def test_quality_samples_rows_not_ids(spark):
    """The bound holds and both labels are drawn where no row has an id of its own."""
    rows = spark.range(4000).select(*(F.rand(k).alias(s) for k, s in enumerate(Q.STATISTICS)), (F.col("id") % 2).cast("int").alias("label")).withColumn("letters", F.col("label") + F.rand(99) / 2)
    model = Q.fit(rows, rows=500, trees=5)
    score = rows.select("label", model.score().alias("s")).groupBy("label").agg(F.avg("s").alias("s")).collect()
    assert {r["label"]: round(r["s"]) for r in score} == {0: 0, 1: 1}
