"""The graph language: tokens, statements as rows of a tree, validation, and changes to graph tables.

    C► NODE|LINK uid "text" ◄     create; U► update, D► delete, E► evaluate alike
    N► [timeout] "text" ◄         navigate
    IF► command block {ELIF► command block} [ELSE► block] ◄
    LOOP► "condition" ◄ block ◄

Texts are cut by one pattern, tokens or parts of statements; blocks are depths, which windows over the rows of a program
count. programs are (program_id, text), program_id their key; a null text is an empty program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRING = r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"'
# The token classes of the language, in the order in which they are tried.
TOKENS = (
    ("KEYWORD", r"C►|U►|D►|E►|N►|IF►|ELIF►|ELSE►|LOOP►|END►"), ("CLOSE", r"◄"), ("NUMBER", r"\d+(?:\.\d+)?"), ("STRING", STRING),
    ("IDENT", r"[A-Za-z_][A-Za-z0-9_]*"), ("OP", r"==|!=|<=|>=|[+\-*/<>]"), ("SYMBOL", r"[{}(),:;]"), ("WS", r"\s+"),
)
COMMANDS = {"C►": "create", "U►": "update", "D►": "delete", "E►": "evaluate", "N►": "navigate"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", '"': '"', "\\": "\\", "'": "'", "\n": ""}
#: Escapes of characters by number: two, four or eight hex digits, or up to three octal ones.
NUMBERED = r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}|\\[0-7]{1,3}"

TOKEN = "(?U)" + "|".join(p for _, p in TOKENS) + "|(?s:.)"
COMMAND = rf"([CUDE]►)\s*+(NODE|LINK)\s++([A-Za-z_][A-Za-z0-9_]*+)\s*+{STRING}\s*+◄"
NAVIGATE = rf"N►\s*+(\d++(?:\.\d++)?+)?+\s*+{STRING}\s*+◄"
#: Commands and heads of loops as wholes, the marks of blocks, blanks, and what fits nowhere.
PART = rf"(?U){COMMAND}|{NAVIGATE}|LOOP►\s*+{STRING}\s*+◄|ELIF►|ELSE►|IF►|◄|\s++|[^CUDENIL◄\s]++|(?s:.)"
#: An innermost block of letters (see letter), which counts as one statement b.
BLOCK = "(?:ic[cb]*+(?:ec[cb]*+)*+(?:l[cb]*+)?+|o[cb]*+)x"


def pieces(pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))


def tokens_of(programs: DataFrame) -> DataFrame:
    """(program_id, seq, type, value, pos) of tokens but blanks; a program with an unknown character is one row of type `ERROR` that tells the first."""
    value = F.col("value")
    rows = programs.select(F.col("program_id").cast("long").alias("program_id"), F.posexplode(pieces(TOKEN)).alias("place", "value"))
    rows = rows.withColumn("type", F.coalesce(*(F.when(value.rlike(rf"(?U)\A(?:{p})\z"), F.lit(k)) for k, p in TOKENS), F.lit("ERROR")))
    program = Window.partitionBy("program_id")
    w = program.orderBy("place")
    rows = rows.select("*", (F.sum(F.length(value)).over(w) - F.length(value)).alias("at"), (F.sum((F.col("type") != "WS").cast("int")).over(w) - 1).alias("nth"))
    rows = rows.select("*", F.min(F.when(F.col("type") == "ERROR", F.col("at"))).over(program).alias("wrong")).where("type <> 'WS' AND (wrong IS NULL OR at = wrong)")
    fine = F.col("wrong").isNull()
    told = F.concat(F.lit("unexpected character '"), value, F.lit("' at "), F.col("at").cast("string"))
    return rows.select(
        "program_id", F.when(fine, F.col("nth")).otherwise(0).cast("int").alias("seq"), "type", F.when(fine, value).otherwise(told).alias("value"), F.when(fine, F.col("at")).otherwise(-1).cast("int").alias("pos")
    )


def letter(part: Column) -> Column:
    """c command, i IF, e ELIF, l ELSE, o LOOP with its condition, x close, w blanks, ? what fits nowhere."""
    marks = {"IF►": "i", "ELIF►": "e", "ELSE►": "l", "◄": "x"}
    whole = F.coalesce(*(F.when(part == k, F.lit(v)) for k, v in marks.items()))
    return F.coalesce(whole, F.when(part.startswith("LOOP►"), F.lit("o")), F.when(part.endswith("◄"), F.lit("c")), F.when(part.rlike(r"(?U)\A\s"), F.lit("w")), F.lit("?"))


def shaped(programs: DataFrame) -> DataFrame:
    """(program_id, parts, kinds, valid): a program is valid if nothing is left but statements once blocks are folded from the inside out, a depth at a time."""
    read = programs.select(F.col("program_id").cast("long").alias("program_id"), pieces(PART).alias("parts"))
    read = read.select("*", F.transform("parts", letter).alias("kinds"))

    def deeper(s: Column, k: Column) -> Column:
        now = s["now"] + F.when(k.isin("i", "o"), 1).when(k == "x", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    depth = F.aggregate("kinds", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper)["most"]
    left = F.aggregate(F.sequence(F.lit(0), depth), F.replace(F.array_join("kinds", ""), F.lit("w"), F.lit("")), lambda s, _: F.regexp_replace(s, BLOCK, "b"))
    return read.select("*", left.rlike(r"\A[cb]*\z").alias("valid"))


def unquote(s: Column) -> Column:
    """Text of a string token; escapes are decoded (half a surrogate pair gives the replacement character), an unknown one and other characters stay."""
    runs = F.regexp_extract_all(F.substring(s, F.lit(2), F.length(s) - 2), F.lit(rf"{NUMBERED}|\\(?s:.)|[^\\]+"), F.lit(0))

    def decoded(run: Column) -> Column:
        coded = run.rlike(rf"^(?:{NUMBERED})$")
        digits = F.when(run.rlike(r"^\\[xuU]"), F.substring(run, F.lit(3), F.length(run))).otherwise(F.conv(F.substring(run, F.lit(2), F.length(run)), 8, 16))
        digits = F.when(coded & ~digits.rlike(r"^(?:0000)?[dD][89A-Fa-f]..$"), digits).otherwise(F.lit("FFFD"))
        number = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        return F.when(coded, number).otherwise(F.coalesce(*(F.when(run == F.lit("\\" + k), F.lit(v)) for k, v in ESCAPES.items()), run))

    return F.array_join(F.transform(runs, decoded), "")


def syntax_trees(programs: DataFrame) -> DataFrame:
    """A row a statement: its parent (-1 at the top), the parent's branch (if, elif0, else, loop, with _condition for the command that decides), its place there, what it says. A program that is not valid is one row of kind `error`."""
    # A valid program's parts, or one that says what is wrong.
    lost = F.instr(F.array_join("kinds", ""), "?")
    where = F.length(F.array_join(F.slice("parts", F.lit(1), F.greatest(lost - 1, F.lit(0))), ""))
    wrong = F.when(lost > 0, F.concat(F.lit("unexpected text at "), where.cast("string"))).otherwise(F.lit("blocks do not fit together"))
    said = F.filter(F.arrays_zip("kinds", "parts"), lambda p: p["kinds"] != "w")
    one = F.array(F.struct(F.lit("?").alias("kinds"), wrong.alias("parts")))
    rows = shaped(programs).select("program_id", F.posexplode(F.when(F.col("valid"), said).otherwise(one)).alias("place", "p")).select("program_id", "place", F.col("p.kinds").alias("k"), F.col("p.parts").alias("part"))

    k, opens = F.col("k"), F.col("k").isin("i", "o")
    w = Window.partitionBy("program_id").orderBy("place")
    step = F.when(opens, 1).when(k == "x", -1).otherwise(0)
    rows = rows.select(
        "*", (F.sum(step).over(w) - F.when(opens, 1).otherwise(0)).alias("level"), (F.sum(k.isin("c", "i", "o", "?").cast("int")).over(w) - 1).alias("node"),
        F.coalesce(F.lag(k).over(w).isin("i", "e"), F.lit(False)).alias("decides"),
    ).where("k <> 'x'")
    # The head of a block stands at its own level as a statement, and one deeper as the start of what follows.
    rows = rows.select("*", F.explode(F.when(opens, F.array("level", F.col("level") + 1)).otherwise(F.array("level"))).alias("at"))
    head = F.col("at") > F.col("level")
    v = Window.partitionBy("program_id", "at").orderBy("place")
    rows = rows.select("*", head.alias("head"), F.last(F.when(head, F.col("node")), True).over(v).alias("parent"), F.last(F.when(head, k), True).over(v).alias("inside"))
    u = Window.partitionBy("program_id", "at", "parent").orderBy("place")
    elifs, other = F.sum((k == "e").cast("int")).over(u), F.max(k == "l").over(u)
    branch = F.when(F.col("parent").isNull(), "top").when(F.col("inside") == "o", "loop").when(other, "else").when(elifs > 0, F.concat(F.lit("elif"), (elifs - 1).cast("string"))).otherwise("if")
    rows = rows.select("*", F.concat(branch, F.when(F.col("decides"), "_condition").otherwise("")).alias("branch")).where(~F.col("head") & k.isin("c", "i", "o", "?"))

    part = F.col("part")
    word = F.coalesce(*(F.when(part.startswith(c), F.lit(n)) for c, n in COMMANDS.items()))
    group = lambda pattern, n: F.when(k == "c", F.nullif(F.regexp_extract(part, "(?U)" + pattern, n), F.lit("")))
    return rows.select(
        "program_id", F.col("node").cast("int").alias("node_id"), F.coalesce("parent", F.lit(-1)).cast("int").alias("parent_id"), "branch",
        (F.row_number().over(Window.partitionBy("program_id", "parent", "branch").orderBy("place")) - 1).alias("seq"),
        F.when(k == "c", word).when(k == "i", "if").when(k == "o", "loop").otherwise("error").alias("kind"), group(COMMAND, 2).alias("entity"), group(COMMAND, 3).alias("uid"),
        F.when(k.isin("c", "o"), unquote(F.regexp_extract(part, STRING, 0))).alias("instruction"), group(NAVIGATE, 1).alias("timeout"), F.when(k == "?", part).alias("error"),
    )


def validity(programs: DataFrame) -> DataFrame:
    return shaped(programs).select("program_id", "valid")


def statistics(programs: DataFrame) -> DataFrame:
    """(total, valid, invalid) programs."""
    return validity(programs).agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def serialized_prompt(text: Column) -> Column:
    """Whether a text is a graph in plain lines, and not a JSON object."""
    return F.coalesce(text.rlike("KG►|KGNODE►") & ~F.regexp_replace(text, r"^\s+", "").startswith("{"), F.lit(False))


def apply_commands(rows: DataFrame, trees: DataFrame, entity: str = "NODE") -> DataFrame:
    """rows (uid, type, props) of nodes, or of links, after the top-level create, update and delete commands on them, last command of a uid last.

    Commands fold per uid: after the last create or delete, the last update counts; an update of what does not exist
    changes nothing. So the last of each kind decides, and commands combine in each task before they are dealt. The
    instruction becomes property `instruction`.
    """
    told = trees.where((F.col("parent_id") == -1) & (F.col("entity") == entity) & F.col("kind").isin("create", "update", "delete")).select("uid", "kind", "instruction", F.struct("program_id", "node_id").alias("at"))
    made, changed = F.when(F.col("kind") != "update", F.col("at")), F.when(F.col("kind") == "update", F.col("at"))
    last = told.groupBy("uid").agg(
        F.max(made).alias("made_at"), F.max_by("kind", made).alias("made"), F.max_by("instruction", made).alias("made_said"), F.max(changed).alias("changed_at"), F.max_by("instruction", changed).alias("changed_said"),
    )
    both = rows.join(last, "uid", "full").where(F.coalesce(F.col("made") == "create", F.col("type").isNotNull()))
    fresh = F.coalesce(F.col("made") == "create", F.lit(False))
    later = F.col("changed_at").isNotNull() & (F.col("made_at").isNull() | (F.col("changed_at") > F.col("made_at")))
    said = F.create_map(F.lit("instruction"), F.when(later, F.col("changed_said")).otherwise(F.col("made_said")))
    props = F.when(fresh, said).when(later, F.map_concat(F.map_filter("props", lambda k, v: k != "instruction"), said)).otherwise(F.col("props"))
    return both.select("uid", F.when(fresh, F.lit(entity.lower())).otherwise(F.col("type")).alias("type"), props.alias("props"))
