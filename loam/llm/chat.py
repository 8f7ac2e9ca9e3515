"""Chat formatting: layouts are told by a fingerprint of their field paths and mapped to canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import partitions, table

#: Declarative mappings. paths: the nested field paths of a layout ([] steps into a list). turns: (role, path) pairs, where a
#: role that begins with $ names the path of the role; each: the list whose items hold role and text; aliases: other
#: names of roles in that layout (a role that isn't among them stays as it is).
LAYOUTS = (
    {"paths": ["role", "text"], "turns": [("$role", "text")]},
    {"paths": ["content", "role"], "turns": [("$role", "content")]},
    {"paths": ["messages[].content", "messages[].role"], "each": "messages", "turns": [("$role", "content")]},
    {"paths": ["conversations[].from", "conversations[].value"], "each": "conversations", "turns": [("$from", "value")], "aliases": {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}},
    {"paths": ["system", "messages[].content", "messages[].role"], "first": [("system", "system")], "each": "messages", "turns": [("$role", "content")]},
    {"paths": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    {"paths": ["completion", "prompt"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    {"paths": ["question", "answer"], "turns": [("user", "question"), ("assistant", "answer")]},
    {"paths": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    {"paths": ["instruction", "input", "output"], "turns": [("user", "instruction+input"), ("assistant", "output")]},
)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; an empty object or list counts as a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(field_paths) -> str:
    """Hash of the sorted field paths: the same for every record of a layout, whatever its values and field order."""
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(x["paths"]): x for x in LAYOUTS}


def pick(value: dict, path: str) -> str:
    found = [value.get(p) for p in path.split("+")]
    return "\n".join("" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in found if x is not None and x != "" or len(found) == 1)


def canonical(record: str | None) -> tuple[str, list[tuple[str, str]] | None]:
    """(fingerprint, turns); turns are None for what is no JSON object or has no mapping."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return fingerprint([]), None
    mark = fingerprint(paths(value))
    layout = MAPPINGS.get(mark)
    if layout is None:
        return mark, None
    turns = [(r, pick(value, p)) for r, p in layout.get("first", [])]
    for item in value[layout["each"]] if "each" in layout else [value]:
        turns += [(pick(item, r[1:]) if r[0] == "$" else r, pick(item, p)) for r, p in layout["turns"]]
    aliases = layout.get("aliases", {})
    return mark, [(aliases.get(r, r), t) for r, t in turns]


# The control strings of the template. No turn's text holds one once it is escaped.
USER, USER_END, ANSWER_END, OTHER, OTHER_MID, OTHER_END = "<s>[INST] ", " [/INST]", " </s>", "<<ROLE ", ">> ", " <</ROLE>>"
CONTROL = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<ROLE|<</ROLE>>|>>")
_first = {"\\": "\\\\", "<": "\\l", "[": "\\b", ">": "\\g"}
_back = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\g": ">"}
SEGMENT = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<ROLE (?P<role>.*?)>> (?P<other>.*?) <</ROLE>>|(?P<answer>.*?) </s>", re.S)


def escape(text: str) -> str:
    """Replaces the first character of each control string, and each backslash, by a backslash and a letter."""
    return CONTROL.sub(lambda m: _first[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lbg]", lambda m: _back[m[0]], text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of the loss mask in it); start equals end where nothing is learnt."""
    body = escape(text)
    if role == "user":
        return f"{USER}{body}{USER_END}", 0, 0
    if role == "assistant":
        return f"{body}{ANSWER_END}", 0, len(body)
    return f"{OTHER}{escape(role)}{OTHER_MID}{body}{OTHER_END}", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of formatted text, unescaped."""
    out, at = [], 0
    while at < len(formatted):
        m = SEGMENT.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else ("user" if kind == "user" else "assistant", unescape(m[kind])))
        at = m.end()
    return out


FORMATTED = "conv_id long, turn long, part int, fingerprint string, role string, segment string, mask_start int, mask_end int"


def format_chats(records: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", record_col: str = "record") -> DataFrame:
    """Formatted turns of JSON records in any known layout; a record holds a whole conversation or one turn of it.

    The text of a conversation is its segments joined by (turn, part); it isn't built as one value, since one
    conversation may hold a third of all rows. mask_start and mask_end (code points within the segment) mark what
    is learnt: each assistant text. A record without a known layout gives one row with its fingerprint and a null
    segment, so that nothing is dropped unseen. Null fields are empty text; rows that repeat are formatted each.
    """
    rows = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(record_col).cast("string").alias("record"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, max(batch.num_rows, 1), 2000):
                out = []
                for conv, turn, record in zip(*(c.to_pylist() for c in batch.slice(k, 2000).columns)):
                    mark, turns = canonical(record)
                    if turns is None:
                        out.append((conv, turn, 0, mark, None, None, None, None))
                    else:
                        out += [(conv, turn, part, mark, r, *segment(r, t)) for part, (r, t) in enumerate(turns)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
                columns = list(zip(*out)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in FORMATTED.split(", ")])

    return rows.mapInArrow(task, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted segments in order.

    Rows of a conversation stream through one task in (turn, part) order; it keeps two running digests and three
    counts, not the rows. A digest of a sequence has to be taken in sequence, so a conversation is not split.
    Rows without an id are one conversation, of id null. A null turn comes first; rows of one turn come in the order
    of their text, repeated rows each. Rows without a known layout aren't read; an empty table gives no rows.
    """
    rows = formatted.where(F.col("segment").isNotNull()).select("conv_id", "turn", "part", "segment", "mask_start", "mask_end")
    dealt = rows.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "part", "segment")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def close():
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_out():
            columns = list(zip(*done)) if done else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in DIGESTS.split(", ")])

        for batch in batches:
            for conv, _, _, text, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                learnt = unescape(text[a:b])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(text)
            yield batch_out()
            done = []
        close()
        yield batch_out()

    return dealt.mapInArrow(task, DIGESTS)


def op6_chat(spark, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    one = lambda text: F.struct("role", F.col("text").alias(text))
    kind = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))  # three layouts that keep roles as they are
    record = F.when(kind == 0, F.to_json(one("text"))).when(kind == 1, F.to_json(one("content"))).otherwise(F.to_json(F.struct(F.array(one("content")).alias("messages"))))
    return read_back(format_chats(said.unionByName(probe).select("conv_id", "turn", record.alias("record"))))


OP6_SQL = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<ROLE|<</ROLE>>|>>')) AS n,
             length(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<ROLE|<</ROLE>>|>>')) AS m FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       CAST(sum(CASE role WHEN 'user' THEN n + 18 WHEN 'assistant' THEN n + 5 ELSE n + m + 20 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
