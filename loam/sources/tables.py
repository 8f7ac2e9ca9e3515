"""Versioned Parquet tables: a commit writes a new version beside the old ones, a reader takes the newest complete one; several tables in one commit by a manifest."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.items import offsets


def _paths(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions of a table, ascending."""
    fs, path, make = _paths(spark, root)
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(make(p, "_SUCCESS")))


def claim(spark: SparkSession, root: str) -> int:
    """The next version of a table, for this writer alone: a marker file is made, which the file system does for one of several writers."""
    fs, path, make = _paths(spark, root)
    fs.mkdirs(make(path, "_claims"))
    version = max(versions(spark, root), default=0) + 1
    while not fs.createNewFile(make(path, f"_claims/{version}")):
        version += 1
    return version


def commit(df: DataFrame, root: str) -> int:
    """Writes df as the next version: readers see all of it or, until it is complete, the one before. Writers that start together get a version each."""
    version = claim(df.sparkSession, root)
    df.write.mode("errorifexists").parquet(f"{root}/v={version}")
    return version


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version if version is not None else ''} in {root}")
    return spark.read.parquet(f"{root}/v={version if version is not None else known[-1]}")


def store_index(indexed: DataFrame, root: str) -> None:
    """Item metadata (file_id, block_id, item, start, end) and block offsets of an index, so that a file is indexed once and searched often."""
    commit(indexed.select("file_id", "block_id", "item", "start", "end"), f"{root}/items")
    commit(offsets(indexed), f"{root}/offsets")


def load_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(item metadata with global_item, block offsets) of a stored index."""
    items, at = load(spark, f"{root}/items"), load(spark, f"{root}/offsets").select("file_id", "block_id", F.col("n").cast("long"), F.col("item_offset").cast("long"))
    return items.join(at.drop("n"), ["file_id", "block_id"]).withColumn("global_item", F.col("item_offset") + F.col("item")).drop("item_offset"), at


class Conflict(RuntimeError):
    """Another writer committed since what this one is based on."""


def _manifests(spark: SparkSession, root: str) -> dict[int, dict[str, str] | None]:
    """Folders of the tables of each commit; None for one that is not complete."""
    fs, path, make = _paths(spark, f"{root}/_commits")
    if not fs.exists(path):
        return {}
    out: dict[int, dict[str, str] | None] = {}
    for status in fs.listStatus(path):
        at = status.getPath()
        if re.fullmatch(r"\d+\.json", at.getName()):
            stream = fs.open(at)
            try:
                text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out[int(at.getName()[:-5])] = json.loads(text) if text.endswith("}\n") else None
    return out


def latest(spark: SparkSession, root: str) -> int:
    """Number of the last complete commit; 0 if there is none."""
    return max((n for n, tables in _manifests(spark, root).items() if tables is not None), default=0)


def commit_all(frames: dict[str, DataFrame], root: str, based_on: int | None = None) -> int:
    """One commit of several tables: a reader sees all of them or none.

    The tables are written to folders of their own; then a manifest that names them is put, which the file system does
    for one of several writers. based_on: the commit that the frames were made from (the last one, if not told). If
    another came since, this one is refused, its folders are deleted and Conflict is raised: read again and repeat.
    A manifest that a stopped writer left open blocks the next commit, whose error names it.
    """
    spark = next(iter(frames.values())).sparkSession
    based_on = latest(spark, root) if based_on is None else based_on
    fs, path, make = _paths(spark, root)
    folder = f"data/{uuid.uuid4().hex}"
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{root}/{folder}/{name}")
    fs.mkdirs(make(path, "_commits"))
    known = _manifests(spark, root)
    at = make(path, f"_commits/{based_on + 1}.json")
    try:
        if max(known, default=0) != based_on:
            raise Conflict(f"commit {max(known)} of {root} came after {based_on}")
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as e:
            raise Conflict(f"{at} of {root} was put by another writer") from e
    except Conflict:
        fs.delete(make(path, folder), True)
        raise
    stream.write(bytearray((json.dumps({name: f"{folder}/{name}" for name in frames}) + "\n").encode()))
    stream.close()
    return based_on + 1


def load_all(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """(number, tables) of the last complete commit, or of an earlier one: all of one commit, whatever is written meanwhile."""
    known = {n: tables for n, tables in _manifests(spark, root).items() if tables is not None}
    number = max(known, default=0) if number is None else number
    if number not in known:
        raise ValueError(f"no commit {number or ''} in {root}")
    return number, {name: spark.read.parquet(f"{root}/{at}") for name, at in known[number].items()}


def save_graph(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame, root: str, based_on: int | None = None) -> int:
    """A graph with its snapshots in one commit (see commit_all)."""
    return commit_all({"nodes": nodes, "edges": edges, "snapshots": snapshots}, root, based_on)


def load_graph(spark: SparkSession, root: str, number: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, found = load_all(spark, root, number)
    return found["nodes"], found["edges"], found["snapshots"]
