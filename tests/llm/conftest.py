import random

import pytest


def brute_words(text):
    """Words of the contract, by their pattern."""
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="session")
def awkward():
    """Rows (doc_id, text) with nulls, empty and long texts, copies, shared passages, controls and many scripts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "ed", "on", "é", "ß", "in", "q"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    passage, rows = prose(70), []
    for i in range(60):
        text = prose(rng.randint(3, 120))
        if i % 5 == 0:
            text = f"{text} {passage} {prose(5)}"
        rows.append((i, text))
    rows += [(100 + i, rows[i][1]) for i in range(0, 12)] + [(120 + i, rows[i][1].replace("on", "no", 1)) for i in range(20, 40)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a" * 700), (204, "\x00\x01" * 60), (205, "日本語のテキスト。" * 20), (206, "😀" * 80), (207, prose(20000)), (208, "!!!"), (209, "a" * 300)]
    return rows


@pytest.fixture(scope="session")
def frame(spark, awkward):
    """The rows beside columns whose names operators use too."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(awkward, "doc_id long, text string").select("doc_id", "text", *(F.lit("x").alias(c) for c in ("h", "rep", "key", "share", "told", "group", "score", "matches", "kept", "number", "slot", "ids")))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
