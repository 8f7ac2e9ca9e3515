"""Average linkage against a plain version that merges the best pair, one by one."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import linkage


def plain(nodes, pairs, k):
    """(merges, clusters of k)."""
    sums = {}
    for a, b, s in pairs:
        if a != b and round(s * linkage.UNIT) > 0:
            key = min(a, b), max(a, b)
            sums[key] = max(sums.get(key, 0), round(s * linkage.UNIT))
    members, out = {n: [n] for n in nodes}, []
    clusters = dict(members) if len(nodes) <= k else None
    while len(members) > 1:
        value = lambda e: sums[e] / (len(members[e[0]]) * len(members[e[1]]))  # noqa: B023, E731
        if sums:
            a, b = min(sums, key=lambda e: (-value(e), e))
            out.append((a, b, sums[a, b] / (len(members[a]) * len(members[b])) / linkage.UNIT))
        else:
            a, b = sorted(members)[:2]
        members[a] = members[a] + members.pop(b)
        moved = {}
        for (x, y), s in sums.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                moved[min(x, y), max(x, y)] = moved.get((min(x, y), max(x, y)), 0) + s
        sums = moved
        if len(members) == k:
            clusters = {m: list(v) for m, v in members.items()}
    return out, {n: c for c, own in (clusters or members).items() for n in own}


CASES = {
    "random": lambda r: [(f"n{r.randint(0, 24):02}", f"n{r.randint(0, 24):02}", r.random()) for _ in range(70)],
    "ties": lambda r: [(f"n{r.randint(0, 17):02}", f"n{r.randint(0, 17):02}", r.choice([0.25, 0.5, 1.0, 0.0])) for _ in range(60)],
    "cliques": lambda r: [(f"n{c}{i}", f"n{c}{j}", 0.9) for c in range(3) for i in range(8) for j in range(i)] + [("n00", "n10", 0.9), ("n03", "n15", 0.4)],
    "star": lambda r: [("m", f"n{i}", 0.5) for i in range(6)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_linkage(spark, case):
    rng = random.Random(4)
    pairs = CASES[case](rng)
    nodes = sorted({n for a, b, _ in pairs for n in (a, b)} | {"a alone", "z alone"})
    made = linkage.merges(spark.createDataFrame([*pairs, ("n00", "n00", 1.0)], "a string, b string, similarity double"))
    frame = spark.createDataFrame([(n,) for n in nodes], "path string")
    want, _ = plain(nodes, pairs, 1)
    assert sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in made.collect()) == sorted((a, b, round(s, 9)) for a, b, s in want)
    for k in (1, 2, 5, len(nodes) - 1, len(nodes) + 3):
        assert dict(tuple(r) for r in linkage.cut(frame, made, k).collect()) == plain(nodes, pairs, k)[1], k


@pytest.mark.parametrize("most", [20, 40])
def test_linkage_of_many_links(spark, monkeypatch, most):
    """With few links a task, clusters merge in tasks beside others that stand still, and by joins where a group has too many."""
    pairs = [(f"n{c}{i}", f"n{c}{j}", 0.9 - c / 100) for c in range(6) for i in range(5) for j in range(i)] + [(f"n{c}0", f"n{(c + 1) % 6}1", 0.3 + c / 100) for c in range(6)]
    monkeypatch.setattr(linkage, "TASK_LINKS", most)
    made = linkage.merges(spark.createDataFrame(pairs, "a string, b string, similarity double"))
    want, _ = plain(sorted({n for a, b, _ in pairs for n in (a, b)}), pairs, 1)
    assert sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in made.collect()) == sorted((a, b, round(s, 9)) for a, b, s in want)


@pytest.mark.parametrize("case", sorted(CASES))
def test_tasks_merge_what_does_not_wait(case):
    """Tasks with a third of the clusters each, again and again, give the merges of the one-by-one order."""
    import pyarrow as pa

    for seed in range(10):
        rng = random.Random(seed)
        pairs = CASES[case](rng)
        links = {}
        for a, b, s in pairs:
            if a != b and round(s * linkage.UNIT) > 0:
                links[min(a, b), max(a, b)] = max(links.get((min(a, b), max(a, b)), 0), round(s * linkage.UNIT))
        nodes = sorted({n for k in links for n in k})
        size, got, want = dict.fromkeys(nodes, 1), [], plain(nodes, pairs, 1)[0]
        for turn in range(200):
            at, root, total = {n: rng.randrange(3 if turn < 50 else 1) for n in nodes}, {}, {}
            for own in range(3):
                rows = [(a, b, s, size[a], size[b], at[a] == own, at[b] == own) for (a, b), s in links.items() if own in (at[a], at[b])]
                for r in linkage.merged_within(pa.Table.from_pylist([dict(zip(("a", "b", "s", "na", "nb", "own_a", "own_b"), x)) for x in rows])).to_pylist() if rows else []:
                    if r["v"] is None:
                        root[r["a"]], total[r["b"]] = r["b"], r["n"]
                    else:
                        got.append((r["a"], r["b"], round(r["v"] / linkage.UNIT, 9)))
            moved = {}
            for (a, b), s in links.items():
                a, b = sorted((root.get(a, a), root.get(b, b)))
                if a != b:
                    moved[a, b] = moved.get((a, b), 0) + s
            links = moved
            size.update(total)
        assert not links and sorted(got) == sorted((a, b, round(s, 9)) for a, b, s in want)


def test_hub_takes_one_round(spark, monkeypatch):
    """Leaves of a hub merge with it one by one, each at another mean, but not one a round."""
    kept, rounds = linkage.written, []
    monkeypatch.setattr(linkage, "written", lambda df, name: (rounds.append(name), kept(df, name))[1])
    pairs = [("hub", f"leaf{i:03}", 0.14 + i / 1e4) for i in range(200)]
    made = linkage.merges(spark.createDataFrame(pairs, "a string, b string, similarity double"))
    assert sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in made.collect()) == sorted((a, b, round(s, 9)) for a, b, s in plain(["hub"] + [b for _, b, _ in pairs], pairs, 1)[0])
    assert rounds.count("merges") == 1


def test_linkage_of_nothing(spark):
    none = spark.createDataFrame([], "a string, b string, similarity double")
    assert linkage.merges(none).count() == 0
    frame = spark.createDataFrame([("x",), ("y",), ("y",)], "path string")
    assert dict(tuple(r) for r in linkage.cut(frame, linkage.merges(none), 2).collect()) == {"x": "x", "y": "y"}
    with pytest.raises(ValueError):
        linkage.cut(frame, none, 0)


def test_clique_takes_one_round(spark, monkeypatch):
    """Files of one directory are alike: they merge at once, not one a round."""
    kept, rounds = linkage.written, []
    monkeypatch.setattr(linkage, "written", lambda df, name: (rounds.append(name), kept(df, name))[1])
    pairs = [(f"f{i:02}", f"f{j:02}", 0.8) for i in range(40) for j in range(i)]
    assert linkage.merges(spark.createDataFrame(pairs, "a string, b string, similarity double")).count() == 39
    assert rounds.count("merges") == 1


def test_directory_clusters(spark):
    """Against a heap that merges the two smallest, one by one; no directory comes to the driver."""
    import heapq

    from loam.operators import deps

    rng = random.Random(6)
    for dirs, most in ((1, 1), (7, 3), (40, 1), (60, 6), (9, 20)):
        paths = sorted({f"d{rng.randint(0, dirs - 1):02}/f{i}" for i in range(dirs * 3)} | {f"d{i:02}/x" for i in range(dirs)})
        sizes = {}
        for p in paths:
            sizes[p.split("/")[0]] = sizes.get(p.split("/")[0], 0) + 1
        heap = [(n, d, [d]) for d, n in sizes.items()]
        heapq.heapify(heap)
        while len(heap) > most:
            (n, a, x), (m, b, y) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (n + m, min(a, b), x + y))
        want = {d: k for k, (_, _, own) in enumerate(sorted(heap, key=lambda h: h[1])) for d in own}
        got = deps.directory_clusters(spark.createDataFrame([(p,) for p in paths], "path string"), most).collect()
        assert len(got) == len(paths) and all(r["cluster"] == want[r["path"].split("/")[0]] for r in got)


@pytest.mark.parametrize("least", [0.7, 0.85])
def test_directory_similarity(spark, least):
    """Classes and exceptions give, expanded, the pairs of one directory that similar_pairs gives."""
    from loam.operators import deps

    rng = random.Random(8)
    folder = lambda: rng.choice(["", "a/", "a/b/", "c/", "a/b/d/", "x/y/z/w/"])
    paths = sorted({folder() + "".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) + rng.choice([".py", ".txt", "", ".a.b"]) for _ in range(120)} | {"a/.py", "c/"})
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    at = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    want = {(r["a"], r["b"]): r["similarity"] for r in deps.similar_pairs(frame, least).collect() if at(r["a"]) == at(r["b"])}
    classes, exceptions = deps.directory_similarity(frame, least)
    got = {}
    for r in classes.collect():
        own = [p for p in paths if at(p) == r["dir"]]
        pairs = {(a, b): r["similarity"] for i, a in enumerate(own) for b in own[i + 1 :]}
        assert (r["files"], r["pairs"]) == (len(own), len(pairs))
        got |= pairs
    got |= {(r["a"], r["b"]): r["similarity"] for r in exceptions.collect()}
    assert got == want and want


def test_hot_directory_stays_small(spark):
    """A directory of 3,000 files has 4,498,500 pairs and one row."""
    from loam.operators import deps

    frame = spark.range(3000).select(F.concat(F.lit("hot/f"), F.col("id") + 1000, F.lit("q.py")).alias("path"))
    classes, exceptions = deps.directory_similarity(frame)
    assert [tuple(r) for r in classes.collect()] == [("hot", 3000, 4_498_500, 0.8)] and exceptions.count() == 0


@pytest.mark.parametrize("most,weight,least", [(0.4, 0.3, 0.7), (0.55, 0.3, 0.7), (0.35, 0.1, 0.25), (0.15, 0.1, 0.3)])
def test_blended_clusters_of_all_pairs(spark, most, weight, least):
    """The clusters that all pairs of blended_pairs give, over nested directories, names alike, paths that end in a slash and roots."""
    from loam.operators import deps

    rng = random.Random(9)
    part = lambda: rng.choice(["a", "b", "ab", "c1"])
    paths = sorted({"/".join([*(part() for _ in range(rng.randint(0, 4))), rng.choice(["", "/"]) * (rng.random() < 0.2) + "".join(rng.choice("12") for _ in range(rng.randint(0, 4))) + rng.choice(["", ".x", ".y.z"])]) for _ in range(150)} | {"/1", "1", "/2.x", ""})
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    edges = spark.createDataFrame(sorted({(rng.choice(paths), rng.choice(paths)) for _ in range(12)} - {(p, p) for p in paths}), "source string, target string")
    root = {p: p for p in paths}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in deps.blended_pairs(frame, edges, weight, least).where(F.col("distance") <= most).collect():
        x, y = sorted((find(r["a"]), find(r["b"])))
        root[y] = x
    got = {r["path"]: r["cluster"] for r in deps.blended_clusters(frame, edges, most, weight, least).collect()}
    assert got == {p: find(p) for p in paths}


def test_hot_directory_connects_by_few(spark):
    """A directory of 3,000 files has 4,498,500 similar pairs; a few for each file connect them."""
    from loam.operators import deps

    frame = spark.range(3000).select(F.concat(F.lit("a/hot/f"), F.col("id") + 1000, F.lit("q.py")).alias("path"))
    assert deps.connecting_pairs(frame, lambda s: s >= 0.7).count() < 4 * 3000


@pytest.mark.parametrize("least", [0.25, 0.45, 0.5, 0.7, 0.95, 1.0])
def test_similar_pairs_in_blocks(spark, monkeypatch, least):
    """Blocks of three files give all pairs of a brute-force comparison: nested directories, names alike, paths that end in a slash or are part of others, roots."""
    from loam.operators import deps

    monkeypatch.setattr(deps, "PAIR_BLOCK", 3)
    rng = random.Random(12)
    part = lambda: rng.choice(["a", "b", "ab"])
    paths = sorted({"/".join([*(part() for _ in range(rng.randint(0, 4))), rng.choice(["", "1", "12", "2.x", "1.y.z", ".x"])]) for _ in range(110)} | {"/1", "1", "/2.x", "", "/", "a/1/", "a/1"})
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    every = frame.select(F.col("path").alias("a")).crossJoin(frame.select(F.col("path").alias("b"))).where("a < b").select("a", "b", F.round(deps.path_similarity(F.col("a"), F.col("b")), 9).alias("s")).where(F.col("s") >= least)
    want = sorted(tuple(r) for r in every.collect())
    assert sorted(tuple(r) for r in deps.similar_pairs(frame, least).collect()) == want and want


def test_pairs_of_hot_directory_are_dealt(spark):
    """The pairs of one directory are the work of several tasks, also where one task holds its files."""
    from loam.operators import deps

    frame = spark.range(6000, numPartitions=1).select(F.concat(F.lit("a/hot/f"), F.col("id") + 1000, F.lit("q.py")).alias("path"))
    dealt = deps.similar_pairs(frame).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in dealt) == 6000 * 5999 // 2 and max(r["count"] for r in dealt) < 0.6 * 6000 * 5999 // 2


@pytest.mark.parametrize("least,weight,most", [(0.7, 0.3, 2), (0.7, 0.3, 5), (0.5, 0.1, 2), (0.3, 0.3, 4)])
def test_average_linkage_by_types(spark, monkeypatch, least, weight, most):
    """The merges that all pairs of blended_pairs give, over nested directories, names alike and empty, paths that are others' directories, roots, adjacent files."""
    from loam.operators import deps

    monkeypatch.setattr(deps, "PLACE_FILES", most)
    rng = random.Random(most)
    part = lambda: rng.choice(["a", "b", "ab", "c1"])
    paths = sorted({"/".join([*(part() for _ in range(rng.randint(0, 3))), rng.choice(["", "1", "12", "2.x", "33", "7.y.z", ".x", "41", "5"]) + rng.choice(["", "6", "x"])]) for _ in range(120)} | {"/1", "/8", "1", "/2.x", "", "a/1/", "a/1", "a/1/2", "a/1/3", "a/1/4"})
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    edges = spark.createDataFrame(sorted({(rng.choice(paths), rng.choice(paths)) for _ in range(30)} - {(p, p) for p in paths}), "source string, target string")
    pairs = deps.blended_pairs(frame, edges, weight, least).select("a", "b", (1 - F.col("distance")).alias("similarity")).collect()
    want, _ = plain(paths, [tuple(r) for r in pairs], 1)
    got = deps.average_linkage(frame, edges, weight, least).collect()
    assert sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in got) == sorted((a, b, round(s, 9)) for a, b, s in want)


def test_average_linkage_makes_no_row_a_pair(spark, monkeypatch):
    """A directory of 1,500 files has 1,124,250 similar pairs; its merges take a few rows for each file."""
    from loam.operators import deps

    kept, most = linkage.written, []
    count = lambda df, name: (lambda made: (most.append(made.count()), made)[1])(kept(df, name))
    monkeypatch.setattr(linkage, "written", count)
    monkeypatch.setattr(deps, "written", count)
    frame = spark.range(1500).select(F.concat(F.lit("a/hot/f"), F.col("id") + 1000, F.lit("q.py")).alias("path"))
    none = spark.createDataFrame([], "source string, target string")
    got = deps.average_linkage(frame, none).orderBy("b").collect()
    assert [r["b"] for r in got] == [f"a/hot/f{i}q.py" for i in range(1001, 2500)] and {r["a"] for r in got} == {"a/hot/f1000q.py"} and max(most) < 8 * 1500


def test_ties_wait_for_a_better_merge(spark, monkeypatch):
    """By joins, too, clusters whose best by name is about to merge with another wait for it, as its new mean may be theirs."""
    monkeypatch.setattr(linkage, "TASK_LINKS", 3)
    names = [f"n{i}" for i in range(7)]
    pairs = [(a, b, 0.95 if (a, b) == ("n0", "n6") else 0.9) for a in names for b in names if a < b] + [("n4", "w", 0.9), ("n0", "o", 0.9), ("o", "p", 0.92)]
    made = linkage.merges(spark.createDataFrame(pairs, "a string, b string, similarity double"))
    want, _ = plain(sorted({n for a, b, _ in pairs for n in (a, b)}), pairs, 1)
    assert sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in made.collect()) == sorted((a, b, round(s, 9)) for a, b, s in want)
