"""Every registered query over empty tables, and over one row without values."""

import pytest

from loam.llm.catalog import queries

TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", (None, None, None, None, None)),
    "benchmark": ("item_id long, text string", (None, None)),
    "labels": ("doc_id long, quality int, toxic int", (None, None, None)),
    "conversations": ("conv_id long, turn long, role string, text string", (None, None, None, None)),
}


@pytest.fixture(scope="module", params=["none", "nulls"])
def sf(request, spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp(request.param))
    for name, (schema, row) in TABLES.items():
        spark.createDataFrame([row] if request.param == "nulls" else [], schema).write.parquet(f"{at}/{name}.parquet")
    return at, request.param


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, name):
    at, kind = sf
    rows = queries()[name](spark, at).collect()
    if name == "op6_chat":
        assert {r["conv_id"] for r in rows} >= {-1}
    elif name in ("op12_collocations", "pipeline") or kind == "none":
        assert rows == []
    else:
        assert len(rows) == 1 and rows[0]["doc_id"] is None
