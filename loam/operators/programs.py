"""Execution of graph-language programs: each is a table of statements with jump targets, run by a program counter, in its row.

Conditions are texts of a fixed list, not code:

    exists, missing, is <text>     of the node or link that E► names; in LOOP► after its uid (`n1 missing`)
    times <n>                      of a LOOP►: its block runs n times
    true, false

Any other text is false, and counted as unknown. C►, U► and D► change the program's own nodes and links (uid to
instruction; an update of what is not there changes nothing); N►, and E► outside a condition, only count as a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a program at most; one that has not ended by then is told as `unending`.
STEPS = 200


def code(trees: DataFrame) -> DataFrame:
    """(program_id, code): the statements of a program by number, with the numbers of what follows: `next` when done or true, `other` when false; -1 ends it. A program with an error has a null code."""
    one = F.struct("node_id", "parent_id", "branch", "kind", F.concat_ws(":", F.lower("entity"), "uid").alias("key"), "instruction", (F.col("kind") == "error").alias("wrong"))
    rows = trees.groupBy("program_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    at = lambda n: F.get(F.col("all"), n)
    base = lambda x: F.regexp_replace(x["branch"], "_condition$", "")
    first = lambda found: F.coalesce(F.get(found, F.lit(0))["node_id"], F.lit(-2))  # noqa: E731  numbers ascend

    def after(x: Column) -> Column:
        """What follows a statement that is done: the next one of its branch, else its loop, else what follows the IF that holds it."""
        def up(s: Column, _: Column) -> Column:
            own = at(s["at"])
            sibling = first(F.filter("all", lambda y: (y["node_id"] > s["at"]) & (y["parent_id"] == own["parent_id"]) & (y["branch"] == own["branch"])))
            parent = own["parent_id"]
            found = F.when(s["found"] != -2, s["found"]).when(sibling != -2, sibling).when(parent == -1, F.lit(-1)).when(at(parent)["kind"] == "loop", parent).otherwise(F.lit(-2))
            return F.struct(F.when(found == -2, parent).otherwise(s["at"]).alias("at"), found.alias("found"))

        start = F.struct(x["node_id"].alias("at"), F.lit(-2).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.size("all")), start, up)["found"]

    def told(x: Column) -> Column:
        condition, follows = x["branch"].endswith("_condition"), at(x["node_id"] + 1)
        inner = (follows["parent_id"] == x["parent_id"]) & (follows["branch"] == base(x))
        whole = after(at(x["parent_id"]))
        later = first(F.filter("all", lambda y: (y["node_id"] > x["node_id"]) & (y["parent_id"] == x["parent_id"]) & (base(y) != base(x))))
        body = F.coalesce(follows["parent_id"] == x["node_id"], F.lit(False))
        next_ = F.when(condition, F.when(F.coalesce(inner, F.lit(False)), x["node_id"] + 1).otherwise(whole)).when(x["kind"] == "if", x["node_id"] + 1).when(x["kind"] == "loop", F.when(body, x["node_id"] + 1).otherwise(x["node_id"])).otherwise(after(x))
        other = F.when(condition, F.when(later != -2, later).otherwise(whole)).when(x["kind"] == "loop", after(x)).otherwise(F.lit(-1))
        word = F.when(x["kind"] == "loop", F.concat(F.lit("node:"), F.regexp_extract(x["instruction"], r"^(\w+) (?:exists|missing|is )", 1))).otherwise(x["key"])
        said = F.when(x["kind"] == "loop", F.regexp_replace(x["instruction"], r"^\w+ (?=exists$|missing$|is )", "")).otherwise(x["instruction"])
        return F.struct(F.when(condition, "condition").otherwise(x["kind"]).alias("kind"), word.alias("key"), said.alias("said"), next_.alias("next"), other.alias("other"))

    wrong = F.exists("all", lambda x: x["wrong"])
    return rows.select("program_id", F.when(~wrong, F.transform("all", told)).alias("code"))


def step(s: Column, _: Column) -> Column:
    """One statement on; a program that has ended stays."""
    now = F.get(F.col("code"), s["pc"])
    kind, key, said = now["kind"], now["key"], now["said"]
    held = F.map_contains_key(s["held"], key)
    count = F.coalesce(F.element_at(s["turns"], s["pc"]), F.lit(0))
    times = F.regexp_extract(said, r"^times (\d{1,9})$", 1)
    asks = kind.isin("condition", "loop")
    true = F.coalesce(
        F.when(said == "true", F.lit(True)).when(said == "false", F.lit(False)).when(said == "exists", held).when(said == "missing", ~held)
        .when(said.startswith("is "), F.coalesce(F.element_at(s["held"], key) == F.substring(said, F.lit(4), F.length(said)), F.lit(False)))
        .when((kind == "loop") & (times != ""), count < times.cast("int"))
    )
    holds = F.coalesce(true, F.lit(False))
    without = F.map_filter(s["held"], lambda k, v: k != key)
    puts = (kind == "create") | (kind == "update") & held
    now_held = F.when(puts, F.map_concat(without, F.create_map(key, said))).when(kind == "delete", without).otherwise(s["held"])
    others = F.map_filter(s["turns"], lambda k, v: k != s["pc"])
    turns = F.when((kind == "loop") & holds, F.map_concat(others, F.create_map(s["pc"], count + 1))).when(kind == "loop", others).otherwise(s["turns"])
    went = F.struct(
        F.when(asks & ~holds, now["other"]).otherwise(now["next"]).alias("pc"), (s["steps"] + 1).alias("steps"),
        (s["unknown"] + F.when(asks & true.isNull(), 1).otherwise(0)).alias("unknown"), now_held.alias("held"), turns.alias("turns"),
    )
    return F.when(s["pc"] == -1, s).otherwise(went)


def execute(trees: DataFrame, most: int = STEPS) -> DataFrame:
    """(program_id, status, steps, unknown, held) of programs (rows of dsl.syntax_trees), run from an empty graph.

    status is `done`, `unending` after `most` steps, or `error` for a program that is not valid. held maps
    `node:uid` and `link:uid` to instructions. Programs run side by side, a row each, in the JVM; a program's
    statements and state are one row, as its text is. An empty program has no rows, here as there.
    """
    zero = [F.lit(0).alias(c) for c in ("pc", "steps", "unknown")]
    start = F.struct(*zero, F.create_map().cast("map<string,string>").alias("held"), F.create_map().cast("map<int,int>").alias("turns"))
    ran = code(trees).select("program_id", "code", F.when(F.col("code").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)).alias("s"))
    status = F.when(F.col("code").isNull(), "error").when(F.col("s.pc") == -1, "done").otherwise("unending")
    return ran.select("program_id", status.alias("status"), F.col("s.steps").alias("steps"), F.col("s.unknown").alias("unknown"), F.col("s.held").alias("held"))
