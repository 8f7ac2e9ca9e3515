"""Rows with null and repeated ids: values against brute force, even shares, samples that follow rows and not ids."""

import random

import pytest
from pyspark.sql import functions as F

from loam.llm import language_id, shares, substring_dedup, suffix_dedup


def mixed(seed, n=60):
    """Rows of which a third have no id and a third an id of several, with copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "é", "on", "q", "日"]) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() + rng.choice(["", "", "", ".", "!\n"]) for _ in range(k))
    passage, rows = prose(40), []
    for i in range(n):
        text = prose(rng.randint(5, 60)) + (f" {passage} " + prose(4) if i % 4 == 0 else "")
        rows.append(((None, 7, i)[i % 3], text))
    return rows + [(None, rows[1][1]), (None, rows[1][1]), (7, rows[1][1]), (7, rows[0][1]), (99, rows[0][1]), (None, None), (7, "")]


def known(d):
    return float("-inf") if d is None else d


def plain_cut(rows, width=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            first[w] = min(first.get(w, float("inf")), known(d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < known(d):
                gone[i : i + width] = b"\1" * width
        out.append((d, len(raw), bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def test_suffix_dedup(spark):
    rows = mixed(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs, share_bytes=1000).collect()), key=repr)
    assert got == plain_cut(rows) and sum(len(k) < n for _, n, k in got) > 10


def test_substring_dedup(spark):
    """Each row is judged by its own text against rows of lesser ids, as in a table where every pair of id and text has one row."""
    rows = mixed(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["kept"]) for r in substring_dedup.substring_dedup(docs, every=True, share_bytes=1000).collect()), key=repr)
    want = []
    for k, (d, t) in enumerate(rows):  # alone beside the rows of lesser ids, which have ids of their own
        lesser = sorted((x for x in rows if known(x[0]) < known(d)), key=lambda x: known(x[0]))
        want.append((d, t, lesser))
    assert len(got) == len(rows)
    for d, t, lesser in want[::9]:
        alone = spark.createDataFrame([*enumerate(x for _, x in lesser), (10_000, t)], "doc_id long, text string")
        kept = substring_dedup.substring_dedup(alone, every=True).where("doc_id = 10000").first()["kept"]
        assert (d, kept) in got


@pytest.mark.parametrize("doc_id", [None, 5])
def test_shares_are_even(spark, doc_id):
    """Neither one id nor one text brings rows to one share."""
    rows = spark.range(0, 4000, 1, 4).select(F.lit(doc_id).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.col("id").cast("string")).alias("text"))
    per = shares.numbered(rows, "doc_id", "text").groupBy(F.pmod(F.hash("row"), F.lit(8)).alias("share")).count().collect()
    assert len(per) == 8 and max(r["count"] for r in per) < 700


def test_sample_follows_rows(spark):
    """Rows without ids, or of one id, are drawn at the rate of the others."""
    for ids in (F.lit(None).cast("long"), F.lit(3).cast("long"), F.col("id")):
        rows = spark.range(4000).select(ids.alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 3900, "en").otherwise("de").alias("lang"))
        drawn = {r["lang"]: r["count"] for r in language_id.sample(rows, {"en": 3900, "de": 100}, 500).groupBy("lang").count().collect()}
        assert drawn["de"] == 100 and 400 < drawn["en"] < 600
