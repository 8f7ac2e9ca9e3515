"""Evaluation of linked nodes: levels over links, cycles told, results passed on level by level, outcome weights.

Nodes are not code: each has one of the fixed operations below, over its own value and the results of its parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.graph import outcome_weight
from loam.session import discard, written

#: Links along which evaluation goes on; a parameter also passes its result.
SEQUENCE, PARAMETER = "eval_sequence", "parameter"
#: Of the parameters' results, and a node's own value; without parameters, the value.
OPERATIONS = {
    "sum": (F.sum, lambda own, x: F.coalesce(own, F.lit(0.0)) + x), "least": (F.min, F.least), "greatest": (F.max, F.greatest),
    "mean": (F.avg, lambda own, x: x), "count": (F.count, lambda own, x: x.cast("double")),
}


def evaluated(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct links (source, target, passes) of the two relations between nodes that exist."""
    own = links.where(F.col("relation").isin(SEQUENCE, PARAMETER)).groupBy("source", "target").agg(F.max(F.col("relation") == PARAMETER).alias("passes"))
    known = nodes.select("uid")
    return own.join(known.withColumnRenamed("uid", "source"), "source", "left_semi").join(known.withColumnRenamed("uid", "target"), "target", "left_semi")


def triggered(links: DataFrame, start: DataFrame) -> DataFrame:
    """(uid) of all nodes that evaluating those of start (uid) evaluates: start, and what links of the two relations lead to. A round goes one link on."""
    own = links.where(F.col("relation").isin(SEQUENCE, PARAMETER)).select("source", "target").distinct()
    seen = written(start.select("uid").distinct(), "triggered")
    new = seen
    while not new.isEmpty():
        found = own.join(new.select(F.col("uid").alias("source")), "source", "left_semi").select(F.col("target").alias("uid")).distinct()
        new = written(found.join(seen, "uid", "left_anti"), "triggered")
        seen = written(seen.unionByName(new), "triggered")
    return seen


def leveled(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(uid, level), a table: 0 for nodes that no link leads to, else one more than the highest before; nodes in a cycle, or behind one, are left out.

    A round takes the nodes that no remaining link leads to, so there are as many as levels; rounds are tables in the
    shared folder.
    """
    left, links, done, level = written(nodes.select("uid").distinct(), "left"), written(own.select("source", "target"), "waiting"), None, 0
    while True:
        ready = left.join(links.select(F.col("target").alias("uid")).distinct(), "uid", "left_anti")
        found = written(ready.select("uid", F.lit(level).alias("level")), "level")
        if found.isEmpty():
            discard(left, links)
            return found if done is None else written(done, "levels")
        done, level = found if done is None else done.unionByName(found), level + 1
        before = left, links
        left = written(left.join(found.select("uid"), "uid", "left_anti"), "left")
        links = written(links.join(found.select(F.col("uid").alias("source")), "source", "left_anti"), "waiting")
        discard(*before)


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, level, cyclic) of nodes (uid): the order of evaluation over links (source, target, relation); cyclic nodes, which a cycle holds or leads to, have no level."""
    found = leveled(nodes, evaluated(nodes, links))
    return nodes.select("uid").distinct().join(found, "uid", "left").select("uid", "level", F.col("level").isNull().alias("cyclic"))


def result(op: Column, own: Column) -> Column:
    """Over the rows of a node's parameters (result): what its operation gives; null for an operation that is none of OPERATIONS."""
    out = F.lit(None).cast("double")
    for name, (total, join) in OPERATIONS.items():
        out = F.when(op == name, F.when(F.count("result") == 0, own).otherwise(join(own, total("result")))).otherwise(out)
    return out


def evaluate(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, level, result, weight) of nodes (uid, op, value, target): results along parameter links, level by level.

    A node combines its parameters' results by `op` (see OPERATIONS); weight is 1 where the result is the target, else
    -1. Null results of parameters don't count. Cyclic nodes have no level, result or weight. Each level joins the links
    into it with the results before, which combine in each task before they are dealt.
    """
    own = evaluated(nodes, links)
    at = leveled(nodes, own)
    last = at.agg(F.max("level")).first()[0]
    told = written(nodes.join(at, "uid").select("uid", "op", F.col("value").cast("double").alias("value"), F.col("target").cast("double").alias("target"), "level"), "nodes")
    passing = written(own.where("passes").join(told.select(F.col("uid").alias("target"), "level"), "target").select("source", "target", "level"), "passing")
    results = None
    for level in range(-1 if last is None else last + 1):
        here = told.where(F.col("level") == level)
        if results is None:
            now = here.select("uid", F.when(F.col("op").isin(*OPERATIONS), F.col("value")).alias("result"))
        else:
            given = passing.where(F.col("level") == level).join(results.withColumnRenamed("uid", "source"), "source").select(F.col("target").alias("uid"), "result")
            now = here.join(given, "uid", "left").groupBy("uid", "op", "value").agg(result(F.col("op"), F.col("value")).alias("result")).select("uid", "result")
        now = written(now, "results")
        results = now if results is None else results.unionByName(now)
    if results is None:
        results = told.select("uid", F.lit(None).cast("double").alias("result"))
    done = told.join(results, "uid").select("uid", "level", "result", outcome_weight(F.col("result"), F.col("target")).alias("weight"))
    return nodes.select("uid").join(done, "uid", "left")
