"""The pipeline against a plain version, its stages' contract, and the registered SQL."""

import corpus_pipeline as P
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loam.llm import catalog

from .conftest import brute_words
from .test_dedup import plain_jaccard
from .test_text import plain_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    now = docs
    expected = {d for d, t in rows.items() if any(c.isalpha() for c in t or "")}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
        got = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "exact":
            last = {}
            for d in expected:
                last[rows[d]] = max(d, last.get(rows[d], d))
            expected = set(last.values())
        if name == "near":
            expected = {d for d, (c, _, _) in plain_jaccard([(d, rows[d]) for d in expected]).items() if c == d}
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            expected = {d for d, (_, hit, _) in plain_hits([(d, rows[d]) for d in expected], items).items() if not hit}
        assert got == expected, name
        now = out
    tokens = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in P.run(spark, SF).collect()}
    assert tokens.keys() == expected and all(n == len(ids) and n for n, ids in tokens.values())


def test_stages_on_awkward_rows(spark, awkward):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in awkward] + [(None, "a null id and some words", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs.unionByName(docs.limit(3)), docs.where("false")):
        for name, stage in P.STAGES:
            frame = stage(spark, frame, SF)
            frame.count()
    assert brute_words("Aé-1") == ["aé", "1"]


def test_stages_know_rows_by_id_and_text(spark):
    """Null ids and repeated ids: each row is judged by its own text."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], schema)
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    rows = [(None, f"before {bench} after"), (2, word(2)), (2, f"{bench} and more"), (None, word(3)), (4, None)]
    assert told(P.clean(spark, frame(rows), SF)) == sorted([(2, word(2)), (None, word(3)), (4, None)], key=repr)
    rows = [(3, word(3)), (None, word(3)), (None, word(4)), (None, f"{word(4)} more"), (5, word(5)), (6, f"{word(5)} more"), (5, word(6)), (7, word(7)), (7, word(7)), (None, word(8))]
    got = told(P.near(spark, frame(rows), SF))
    assert [x for x in got if x[1] not in (word(4), f"{word(4)} more")] == sorted([(3, word(3)), (5, word(5)), (5, word(6)), (7, word(7)), (None, word(8))], key=repr)
    assert sum(x[1] in (word(4), f"{word(4)} more") for x in got) == 1
    rows = [(4, word(4)), (None, word(4)), (5, word(4)), (None, word(5)), (None, word(5)), (6, None), (7, ""), (8, word(6)), (8, word(6)), (8, word(7))]
    assert [(d, t or "") for d, t in told(P.exact(spark, frame(rows), SF))] == sorted([(5, word(4)), (None, word(5)), (7, ""), (8, word(6)), (8, word(7))], key=repr)
    both = frame(rows).withColumn("dropped_id", F.lit(1)).withColumn("dropped_key", F.lit("x"))
    assert P.exact(spark, both, SF).columns == both.columns and P.near(spark, both, SF).columns == both.columns


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else str(v)  # noqa: E731  pandas holds integers beside nulls as floats
    told = lambda df: sorted(str([str(plain(v)) for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert told(got) == told(want)
