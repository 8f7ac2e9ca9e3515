"""Versions kept by a stream, against a plain list for each key."""

import random

import pytest

from loam.sources import tables
from loam.streaming import versions

SCHEMA = "key string, ts long, tie long, back long, data string"


def plain(batches):
    held, out = {}, []
    for rows in batches:
        for key, ts, _, back, data in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
            own = held.setdefault(key, [])
            error = None
            if back is not None:
                if 0 <= back < len(own):
                    data = own[back][1]
                else:
                    data, error = (own[-1][1] if own else None), f"no version {back}"
            own.append((ts, data))
            out.append((key, len(own) - 1, ts, data, error))
    return sorted(out), held


def test_versions(spark, tmp_path):
    """Three runs with restarts between them, changes and rollbacks (to rollbacks too), versions that are not there; a batch that is tried again changes nothing."""
    rng = random.Random(7)
    clock, batches = 0, []
    for _ in range(3):
        rows = []
        for _ in range(40):
            clock += rng.randint(0, 1)
            rows.append((rng.choice("abc"), clock, rng.randint(0, 10**9), rng.choice([None, None, 0, 1, 3, 9, -1]), f"d{rng.randint(0, 9)}"))
        batches.append(rows)
        clock += 1
    source, root = str(tmp_path / "in"), str(tmp_path / "kept")
    with pytest.raises(ValueError):
        versions.all_versions(spark, root)
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        versions.keep(spark.readStream.schema(SCHEMA).parquet(source), root, str(tmp_path / "c")).awaitTermination()
    want, held = plain(batches)
    found = versions.all_versions(spark, root)
    assert sorted(tuple(r) for r in versions.history(found).collect()) == want
    versions.add(spark.createDataFrame(batches[1], SCHEMA), 1, root)  # tried again
    assert tables.latest(spark, root) == 3 and versions.all_versions(spark, root).count() == 120
    for ts in (0, clock // 2, clock):
        state = {}
        for key, own in held.items():
            for k, (at, data) in enumerate(own):
                if at <= ts:
                    state[key] = (k, data)
        assert {r["key"]: (r["idx"], r["data"]) for r in versions.as_of(found, ts).collect()} == state
    (tmp_path / "kept" / "versions" / "3").mkdir()  # what a stopped batch left is not read
    assert versions.all_versions(spark, root).count() == 120
    spark.createDataFrame([("z", 1, 1, 5, "x")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    versions.keep(spark.readStream.schema(SCHEMA).parquet(source), root, str(tmp_path / "c")).awaitTermination()
    z = versions.history(versions.all_versions(spark, root)).where("key = 'z'").first()
    assert (z["idx"], z["data"], z["error"]) == (0, None, "no version 5")
