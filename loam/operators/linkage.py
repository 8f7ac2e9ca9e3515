"""Average linkage over a sparse graph of similarities, by rounds of reciprocal nearest clusters."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.components import components
from loam.session import discard, written

#: Similarities are summed as whole numbers of this unit, so that sums and ties do not depend on the order of rows.
UNIT = 1_000_000_000
#: Links of the clusters that a task merges among themselves (about 0.4 KB each); larger groups merge by joins.
TASK_LINKS = 500_000


def merged_within(links: pa.Table) -> pa.Table:
    """Merges of the clusters of a task by their links (a, b, s, na, nb, own_a, own_b); own tells which ends are the task's.

    (a, b, v, n): with v, b went into a; without, the task's cluster a is now part of b, of n members. Other clusters
    stand still: a mean only falls as they merge, so a pair that is best beside their present links stays best. A
    cluster whose best is another task's, or waits for such a one, is left. Nearest neighbours are followed until two
    are each other's best. Each cluster has a heap of s / n of its neighbours, the order of which its own size does
    not touch; entries are bounds from above and are renewed where they come up. The neighbours of the cluster that
    has fewer move on a merge.
    """
    ends = [links.column(c).to_pylist() for c in ("a", "b")]
    names = sorted(set(ends[0]) | set(ends[1]))
    number = {x: i for i, x in enumerate(names)}
    size, own, near = [0] * len(names), [False] * len(names), [{} for _ in names]
    for a, b, s, na, nb, own_a, own_b in zip(*ends, *(links.column(c).to_pylist() for c in ("s", "na", "nb", "own_a", "own_b"))):
        a, b = number[a], number[b]
        size[a], size[b], own[a], own[b] = na, nb, own_a, own_b
        near[a][b] = near[b][a] = s
    least = list(range(len(names)))  # of a cluster, the number of its name
    heaps = [[(-(s / size[y]), y, y) for y, s in near[x].items()] if own[x] else [] for x in range(len(names))]
    for h in heaps:
        heapq.heapify(h)
    start, gone, parent, rows = list(size), [False] * len(names), list(range(len(names))), []

    def nearest(x: int) -> int | None:
        h = heaps[x]
        while h:
            value, name, y = h[0]
            if gone[y]:
                heapq.heappop(h)
                continue
            now = -(near[x][y] / size[y]), least[y], y
            if now == (value, name, y):
                return y
            heapq.heapreplace(h, now)
        return None

    def merge(x: int, y: int) -> int:
        kept, other = (x, y) if len(near[x]) >= len(near[y]) else (y, x)
        s = near[kept].pop(other)
        a, b = sorted((least[x], least[y]))
        rows.append((names[a], names[b], float(s) / float(size[x] * size[y]), 0))
        del near[other][kept]
        gone[other], parent[other], least[kept] = True, kept, a
        size[kept] += size[other]
        for z, s in near[other].items():
            del near[z][other]
            near[kept][z] = near[z][kept] = s = near[kept].get(z, 0) + s
            heapq.heappush(heaps[kept], (-(s / size[z]), least[z], z))
            if own[z]:
                heapq.heappush(heaps[z], (-(s / size[kept]), a, kept))
        near[other], heaps[other] = {}, []
        return kept

    waits = [not x for x in own]
    todo = [x for x in range(len(names)) if own[x]]
    while todo:
        chain = [todo.pop()]
        while chain:
            x = chain[-1]
            y = None if gone[x] or waits[x] else nearest(x)
            if y is None or waits[y]:
                for x in chain:
                    waits[x] = True
                break
            if len(chain) > 1 and (y == chain[-2] or y in chain):  # the latter only where means differ by less than a double tells
                todo.append(merge(x, y))
                chain = chain[:-2] if y == chain[-2] else []
            else:
                chain.append(y)
    for x in range(len(names)):
        root = x
        while parent[root] != root:
            root = parent[root]
        if size[root] != start[x]:
            rows.append((names[x], names[least[root]], None, size[root]))
    kind = links.schema.field("a").type
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table({c: pa.array(v, k) for c, v, k in zip(("a", "b", "v", "n"), columns, (kind, kind, pa.float64(), pa.int64()))})


def merged_group(kinds: list[int], xs: list[str], ys: list[str], ss: list[int]) -> list[tuple]:
    """Merges of the clusters of a group, the links of which are told by type, and by rows where a pair has more than its types tell.

    Rows (kind, x, y, s): 0, a node x of type y; 1, types x and y, of which each pair has s; 2, nodes x and y have s
    more; 3, node x and the other group's node y have s. Rows made (kind, a, b, v, n, m): 0, b went into a at v; 1, node
    a is now part of b, of n members; 2, cluster a, which is left beside others, has n members of type b among m.

    Other groups stand still, as in merged_within. A cluster counts its members by type, so its mean with another is a
    product of counts: clusters of equal shares of types are alike to all others, and of each such kind the least name
    is asked, not each cluster. Means are compared as fractions.
    """
    names = sorted({x for k, x in zip(kinds, xs) if k == 0} | {y for k, y in zip(kinds, ys) if k == 3})
    number = {x: i for i, x in enumerate(names)}
    known: dict[str, int] = {}
    between: list[dict[int, int]] = []
    for k, x, y, s in zip(kinds, xs, ys, ss):
        if k == 1:
            for z in (x, y):
                if z not in known:
                    known[z] = len(between)
                    between.append({})
            between[known[x]][known[y]] = between[known[y]][known[x]] = s
    labels = list(known)
    count = len(names)
    size, least, gone, waits, parent = [1] * count, list(range(count)), [False] * count, [True] * count, list(range(count))
    held: list[dict[int, int]] = [{} for _ in range(count)]  # members by type
    pull: list[dict[int, int]] = [{} for _ in range(count)]  # of a type, the sum of what a member of it has with the cluster
    near: list[dict[int, int]] = [{} for _ in range(count)]
    far: list[dict[int, int]] = [{} for _ in range(count)]
    heaps: list[list[tuple[int, int]]] = [[] for _ in range(count)]
    for k, x, y, s in zip(kinds, xs, ys, ss):
        if k == 0:
            i = number[x]
            waits[i] = False
            if y in known:
                held[i], pull[i] = {known[y]: 1}, between[known[y]]
        elif k == 2:
            near[number[x]][number[y]] = near[number[y]][number[x]] = s
        elif k == 3:
            far[number[x]][number[y]] = s
            heaps[number[x]].append((-s, number[y]))
    for h in heaps:
        heapq.heapify(h)
    shares: list[tuple | None] = [None] * count
    alike: dict[tuple, list[tuple[int, int]]] = {}  # of equal shares, the clusters by name
    having: list[dict[tuple, None]] = [{} for _ in between]  # of a type, the shares with it
    rows = []

    def enter(x: int) -> None:
        if not held[x]:
            return
        g = math.gcd(size[x], *held[x].values())
        key = shares[x] = size[x] // g, tuple(sorted((t, c // g) for t, c in held[x].items()))
        if key not in alike:
            alike[key] = []
            for t in held[x]:
                having[t][key] = None
        insort(alike[key], (least[x], x))

    def leave(x: int) -> None:
        key = shares[x]
        if key is None:
            return
        group = alike[key]
        group.pop(bisect_left(group, (least[x], x)))
        if not group:
            del alike[key]
            for t, _ in key[1]:
                del having[t][key]

    def nearest(x: int) -> int | None:
        """The best cluster; -1 for one that stands still."""
        drawn, top, under, name, best = pull[x], 0, 1, -1, None
        if drawn:
            keys = having[next(iter(drawn))] if len(drawn) == 1 else {k: None for t in drawn for k in having[t]}
            for key in keys:
                group = alike[key]
                found = group[0]
                if found[1] == x:
                    if len(group) == 1:
                        continue
                    found = group[1]
                s = 0
                for t, c in key[1]:
                    if t in drawn:
                        s += drawn[t] * c
                one, other = s * under, top * key[0]
                if one > other or one == other and found[0] < name:
                    top, under, name, best = s, key[0], found[0], found[1]
        for y, s in near[x].items():
            for t, c in held[y].items():
                if t in drawn:
                    s += drawn[t] * c
            one, other = s * under, top * size[y]
            if one > other or one == other and least[y] < name:
                top, under, name, best = s, size[y], least[y], y
        h = heaps[x]
        while h and far[x][h[0][1]] != -h[0][0]:
            heapq.heappop(h)
        if h:
            one = -h[0][0] * under
            if one > top or one == top and h[0][1] < name:
                best = -1
        return best

    def merge(x: int, y: int) -> int:
        kept, other = (x, y) if len(near[x]) + len(far[x]) >= len(near[y]) + len(far[y]) else (y, x)
        s = near[kept].pop(other, 0) + sum(pull[kept][t] * c for t, c in held[other].items() if t in pull[kept])
        near[other].pop(kept, None)
        leave(x)
        leave(y)
        a, b = sorted((least[x], least[y]))
        rows.append((0, names[a], names[b], float(s) / float(size[x] * size[y]), 0, 0))
        gone[other], parent[other], least[kept] = True, kept, a
        size[kept] += size[other]
        for z, more in near[other].items():
            del near[z][other]
            near[kept][z] = near[z][kept] = near[kept].get(z, 0) + more
        for z, more in far[other].items():
            far[kept][z] = more = far[kept].get(z, 0) + more
            heapq.heappush(heaps[kept], (-more, z))
        for sums in (held, pull):
            long, short = (sums[x], sums[y]) if len(sums[x]) >= len(sums[y]) else (sums[y], sums[x])
            # a node's pull is its type's, of which others make use
            long = dict(long) if sums is pull and 1 in (size[kept] - size[other], size[other]) else long
            for t, c in short.items():
                long[t] = long.get(t, 0) + c
            sums[kept], sums[other] = long, {}
        near[other], far[other], heaps[other] = {}, {}, []
        enter(kept)
        return kept

    own = [x for x in range(count) if not waits[x]]
    for x in own:
        enter(x)
    todo = list(own)
    while todo:
        chain = [todo.pop()]
        while chain:
            x = chain[-1]
            y = None if gone[x] or waits[x] else nearest(x)
            if y is None or y < 0 or waits[y]:
                for x in chain:
                    waits[x] = True
                break
            if len(chain) > 1 and y == chain[-2]:
                todo.append(merge(x, y))
                chain = chain[:-2]
            else:
                chain.append(y)
    left = [x for x in own if not gone[x]]
    if len(left) > 1:
        rows += [(2, names[least[x]], labels[t], None, c, size[x]) for x in left for t, c in held[x].items()]
    for x in own:
        root = x
        while parent[root] != root:
            parent[root] = parent[parent[root]]
            root = parent[root]
        if size[root] > 1:
            rows.append((1, names[x], names[least[root]], None, size[root], 0))
    return rows


def by_tasks(links: DataFrame) -> DataFrame:
    """The rows of merged_within over links with the buckets (at_a, at_b) of their ends; a link goes to either end's."""
    kind = links.schema["a"].dataType.simpleString()
    dealt = links.select("*", F.explode(F.array_distinct(F.array("at_a", "at_b"))).alias("at"))
    dealt = dealt.select("at", "a", "b", "s", "na", "nb", (F.col("at_a") == F.col("at")).alias("own_a"), (F.col("at_b") == F.col("at")).alias("own_b"))
    return dealt.groupBy("at").applyInArrow(merged_within, f"a {kind}, b {kind}, v double, n long")


def neighbourhoods(links: DataFrame, count: int) -> DataFrame | None:
    """links with the buckets of their ends: clusters that lead to one another as nearest ones are together; None if those of one group have more than TASK_LINKS links."""
    v = F.col("s") / (F.col("na") * F.col("nb"))
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.struct((-v).alias("v"), F.col("b").alias("y")).alias("to")), F.struct(F.col("b").alias("x"), F.struct((-v).alias("v"), F.col("a").alias("y")).alias("to")))).alias("e")).select("e.*")
    best = written(ends.groupBy("x").agg(F.min("to").alias("to"), F.count("*").alias("links")).select("x", F.col("to.y").alias("y"), "links"), "nearest")
    roots = components(best, "x", "y").select(F.col("node").alias("x"), "root")
    of = written(best.join(roots, "x", "left").select("x", F.coalesce("root", "x").alias("root"), "links"), "groups")
    most = of.groupBy("root").agg(F.sum("links").alias("n")).agg(F.max("n")).first()[0]
    discard(best)
    if most > 2 * TASK_LINKS:  # a link within counts twice
        return None
    at = of.select("x", F.pmod(F.xxhash64("root"), F.lit(math.ceil(4 * count / TASK_LINKS))).alias("at"))
    told = lambda side: at.select(F.col("x").alias(side), F.col("at").alias(f"at_{side}"))
    return links.join(told("a"), "a").join(told("b"), "b")


def contracted(links: DataFrame, joined: DataFrame) -> DataFrame:
    """links after clusters x became part of root, of total members."""
    now = lambda side: joined.select(F.col("x").alias(side), F.col("root").alias(f"root_{side}"), F.col("total").alias(f"total_{side}"))
    moved = links.join(now("a"), "a", "left").join(now("b"), "b", "left")
    moved = moved.select("s", F.coalesce("root_a", "a").alias("x"), F.coalesce("total_a", "na").alias("nx"), F.coalesce("root_b", "b").alias("y"), F.coalesce("total_b", "nb").alias("ny")).where("x <> y")
    left = F.col("x") < F.col("y")
    moved = moved.select("s", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(left, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(left, F.col("ny")).otherwise(F.col("nx")).alias("nb"))
    return written(moved.groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb")), "links")


def merges(pairs: DataFrame, a: str = "a", b: str = "b", similarity: str = "similarity") -> DataFrame:
    """The dendrogram (a, b, similarity): cluster b goes into a; a cluster is named by its least member.

    The similarity of two clusters is the mean over all pairs of their members, of which absent pairs count 0. Each
    merge is the best that is left: the highest similarity, of equal ones the least names. Pairs of a similarity of 0
    or less never merge, a pair given twice counts its highest, and loops are ignored.

    A round merges, at once, all clusters that are each other's best. Since a mean is never above its parts, such
    a pair stays best whatever else merges, so the rounds give the merges of the one-by-one order. Clusters that are
    all each other's best with one similarity (files of a directory) merge in one round, however many. Rounds are
    tables in the shared folder; a cluster's links are reduced to their best before its rows are dealt.

    Where clusters that lead to one another as nearest ones have few links, a task merges them as far as they go
    without others, which takes few rounds (a hub with many leaves merges one at a time); at most TASK_LINKS links
    that are left are merged to the end.
    """
    start = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.round(F.col(similarity) * UNIT).cast("long").alias("s"))
    links = written(start.where("s > 0").groupBy("a", "b").agg(F.max("s").alias("s")).select("a", "b", "s", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")), "links")
    return merged(links, [])


def merged(links: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """The dendrogram of links (a, b, s, na, nb) of clusters, with the merges (a, b, v) of the rounds before."""
    mean = F.col("s") / (F.col("na") * F.col("nb"))
    while count := links.count():
        near = links.select("*", F.lit(0).alias("at_a"), F.lit(0).alias("at_b")) if count <= TASK_LINKS else neighbourhoods(links, count)
        if near is not None:
            done = written(by_tasks(near), "merges")
            rounds.append(done.where("v IS NOT NULL").select("a", "b", "v"))
            before, links = links, contracted(links, done.where("v IS NULL").select(F.col("a").alias("x"), F.col("b").alias("root"), F.col("n").alias("total")))
            discard(before)
            continue
        valued = links.withColumn("v", mean)
        ends = valued.select("v", F.explode(F.array("a", "b")).alias("x"))
        best = ends.groupBy("x").agg(F.max("v").alias("most"))
        of = lambda side: best.select(F.col("x").alias(side), F.col("most").alias(f"most_{side}"))
        tops = valued.join(of("a"), "a").join(of("b"), "b").where("v = most_a OR v = most_b")
        ties = written(tops.select("a", "b", "v", "na", "nb", F.expr("v = most_a").alias("top_a"), F.expr("v = most_b").alias("top_b")), "ties")
        key = F.struct("a", "b")
        end = lambda x: F.struct(F.col(x).alias("x"), F.col(f"n{x}").alias("n"), key.alias("key"), F.col(f"top_{x}").alias("top"))
        nodes = ties.select(F.explode(F.array(end("a"), end("b"))).alias("e")).select("e.*").where("top")  # also links that are one end's best alone: it waits for the other
        nodes = nodes.groupBy("x").agg(F.max("n").alias("n"), F.count("*").alias("degree"), F.min("key").alias("first"))
        nodes = nodes.withColumn("leader", F.col("first.a"))
        told = lambda side: nodes.select(F.col("x").alias(side), F.col("degree").alias(f"degree_{side}"), F.col("leader").alias(f"leader_{side}"), F.col("first").alias(f"first_{side}"))
        edges = written(ties.where("top_a AND top_b").join(told("a"), "a").join(told("b"), "b"), "ties")
        inner = edges.where("leader_a = leader_b").groupBy(F.col("leader_a").alias("leader")).agg(F.count("*").alias("inside"), F.min("v").alias("v"))
        groups = nodes.groupBy("leader").agg(F.count("*").alias("members"), F.min("degree").alias("low"), F.max("degree").alias("high"), F.sum("n").alias("total")).join(inner, "leader")
        whole = groups.where("low = members - 1 AND high = members - 1 AND inside = members * (members - 1) / 2")
        cliques = nodes.select("x", "leader").join(whole.select("leader", "v", "total"), "leader").select("x", F.col("leader").alias("root"), "v", "total")
        single = edges.where((F.col("first_a") == F.struct("a", "b")) & (F.col("first_b") == F.struct("a", "b"))).join(whole.select(F.col("leader").alias("leader_a")), "leader_a", "left_anti")
        single = single.select(F.explode(F.array("a", "b")).alias("x"), F.col("a").alias("root"), "v", (F.col("na") + F.col("nb")).alias("total"))
        joined = written(cliques.unionByName(single), "joined")
        rounds.append(written(joined.where("x <> root").select(F.col("root").alias("a"), F.col("x").alias("b"), F.col("v")), "merges"))
        before, links = links, contracted(links, joined)
        discard(before, ties, edges, joined)
    none = links.select("a", "b", F.lit(0.0).alias("v"))  # of the type of the names
    return reduce(DataFrame.unionByName, rounds, none).select("a", "b", (F.col("v") / UNIT).alias("similarity"))


def merges_by_type(nodes: DataFrame, between: DataFrame, extra: DataFrame) -> DataFrame:
    """The dendrogram that merges() gives, of links that need no row a pair, as most are told by the types of their ends.

    nodes (x, type), each once; between (t, u, s), t <= u: each pair of nodes of types t and u has s (in UNIT);
    extra (a, b, s, weak), a < b: a pair that has s > 0 more than its types tell. Nodes that such links connect, but for
    weak ones, are a group, which merges in one task as far as it goes without others: what that task holds grows with
    nodes and extra links, not with pairs. Clusters that are left get links as rows, and merge as in merges().
    """
    linked = between.select(F.col("t").alias("type")).unionByName(between.select(F.col("u").alias("type"))).distinct()
    n, t = lambda c: F.concat(F.lit("n"), F.col(c)), lambda c: F.concat(F.lit("t"), F.col(c))
    edges = nodes.join(linked, "type").select(n("x").alias("a"), t("type").alias("b"))
    edges = edges.unionByName(between.where("t <> u").select(t("t").alias("a"), t("u").alias("b"))).unionByName(extra.where("NOT weak").select(n("a").alias("a"), n("b").alias("b")))
    roots = components(edges)
    # the root itself has no row: its own name is its group's
    member = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "groups")
    of = lambda kind, name: member.where(F.col("node").startswith(kind)).select(F.substring("node", 2, 1 << 30).alias(name), F.col("root").alias(f"g_{name}"))
    zero = F.lit(0).cast("long")
    row = lambda df, g, kind, x, y, s: df.select(F.col(g).alias("g"), F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), s.alias("s"))
    c = F.col
    ends = written(extra.join(of("n", "a"), "a", "left").join(of("n", "b"), "b", "left").select("a", "b", "s", "g_a", "g_b"), "extra")
    across = ends.where("NOT (g_a <=> g_b)")
    told = reduce(DataFrame.unionByName, [
        row(nodes.join(of("n", "x"), "x"), "g_x", 0, c("x"), c("type"), zero), row(between.join(of("t", "t"), "t"), "g_t", 1, c("t"), c("u"), c("s")),
        row(ends.where("g_a = g_b"), "g_a", 2, c("a"), c("b"), c("s")), row(across.where("g_a IS NOT NULL"), "g_a", 3, c("a"), c("b"), c("s")), row(across.where("g_b IS NOT NULL"), "g_b", 3, c("b"), c("a"), c("s")),
    ])
    tasks = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(rows: pa.Table) -> pa.Table:
        rows, out = rows.sort_by("g"), []
        g, columns = rows.column("g").to_pylist(), [rows.column(k).to_pylist() for k in ("kind", "x", "y", "s")]
        i = 0
        while i < len(g):
            j = i + 1
            while j < len(g) and g[j] == g[i]:
                j += 1
            out += merged_group(*(x[i:j] for x in columns))
            i = j
        made = list(zip(*out)) if out else [[]] * 6
        kinds = (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        return pa.table({k: pa.array(v, kind) for k, v, kind in zip(("kind", "a", "b", "v", "n", "m"), made, kinds)})

    at = F.pmod(F.xxhash64("g"), F.lit(tasks))
    done = written(told.withColumn("at", at).repartition(tasks, "at").groupBy("at").applyInArrow(task, "kind int, a string, b string, v double, n long, m long"), "merges")
    left = done.where("kind = 2")
    both = between.select("t", "u", "s").unionByName(between.where("t <> u").select(c("u").alias("t"), c("t").alias("u"), "s"))
    one, other = left.select("a", c("b").alias("t"), c("n").alias("n_a"), c("m").alias("na")), left.select(c("a").alias("b"), c("b").alias("u"), c("n").alias("n_b"), c("m").alias("nb"))
    implied = one.join(both, "t").join(other, "u").where("a < b").select("a", "b", (c("s") * c("n_a") * c("n_b")).alias("s"), "na", "nb")
    single = F.lit(1).cast("long")
    rest = contracted(ends.select("a", "b", "s", single.alias("na"), single.alias("nb")), done.where("kind = 1").select(c("a").alias("x"), c("b").alias("root"), c("n").alias("total")))
    links = written(rest.unionByName(implied).groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb")), "links")
    discard(rest, member, ends)
    return merged(links, [done.where("kind = 0").select("a", "b", "v")])


def cut(nodes: DataFrame, dendrogram: DataFrame, k: int, node: str = "path") -> DataFrame:
    """(node, cluster): the k clusters (as many as there are nodes, if fewer) that are left before the last merges.

    Where more than k trees have no similarity to each other, those with the least names merge at 0, as the
    one-by-one order does. Only the last merges, and the names of k - 1 trees, are put in order: k is what a user asks
    for.
    """
    if k < 1:
        raise ValueError("there is one cluster at least")
    every = nodes.select(F.col(node).alias("node")).distinct()
    trees = every.count() - dendrogram.count()
    kept = dendrogram
    if k > trees:
        last = dendrogram.orderBy("similarity", F.desc("a"), F.desc("b")).limit(k - trees)
        kept = dendrogram.join(last.select("a", "b"), ["a", "b"], "left_anti")
    roots = components(kept.select("a", "b")).select("node", "root")
    found = every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))
    if k < trees:
        own = found.where("node = cluster").select("cluster").orderBy(F.desc("cluster")).limit(k - 1).withColumn("own", F.lit(True))
        least = found.agg(F.min("cluster").alias("least"))  # one row
        found = found.join(own, "cluster", "left").crossJoin(F.broadcast(least)).select("node", F.when(F.col("own"), F.col("cluster")).otherwise(F.col("least")).alias("cluster"))
    return found.select(F.col("node").alias(node), "cluster")
