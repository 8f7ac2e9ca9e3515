"""Items of delimited files by number: a data source that reads the bytes of the asked items alone, by stored offsets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from loam.sources import tables
from loam.sources.files import item_index

SCHEMA = "file string, item long, start long, end long, content string"
#: Bytes between two asked items that are read along rather than skipped, and bytes of one read at most (an item at least).
GAP, READ = 64 << 10, 8 << 20


def store_offsets(spark: SparkSession, path: str, root: str, begin: str | None = None, brk: str = "\r\n", header: bool = False) -> None:
    """Writes (file, item, start, end) of all items of delimited files below root, in bytes, sorted by item: a file is indexed once, however often it is read."""
    found = item_index(spark, path, begin, brk, header, unit="bytes").select("file_id", "item", "start", "end")
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")).select(F.sha2(F.col("file").cast("binary"), 256).alias("file_id"), "file")  # contents are not read
    rows = found.join(names, "file_id").select("file", "item", "start", "end")
    tables.commit(rows.repartitionByRange("item", "file").sortWithinPartitions("item", "file"), root)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI: a local one (file:/x too), or any that Arrow knows."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def runs(ranges: Iterable[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[list[tuple[int, int]]]:
    """Ascending (start, end) in groups that one read takes: of neighbours at most `gap` apart, `most` bytes together."""
    group: list[tuple[int, int]] = []
    for start, end in ranges:
        if group and (start - group[-1][1] > gap or end - group[0][0] > most):
            yield group
            group = []
        group.append((start, end))
    if group:
        yield group


def read_ranges(file, ranges: Iterable[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[bytes]:
    """Bytes start to end of an open file, for ascending ranges; what lies further apart than `gap` is not read."""
    for group in runs(ranges, gap, most):
        file.seek(group[0][0])
        data = file.read(group[-1][1] - group[0][0])
        for start, end in group:
            yield data[start - group[0][0] : end - group[0][0]]


@dataclass
class Fragment(InputPartition):
    """A file of the offsets; it holds items of one range of numbers."""

    path: str


class ItemReader(DataSourceReader):
    """Options: offsets (a folder of store_offsets' table), first, last (item numbers), break."""

    def __init__(self, options: dict[str, str]):
        self.root, self.brk = options["offsets"], options.get("break", "\r\n").encode()
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", (1 << 63) - 1))
        self.listed: list[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds and lists of item numbers are met here; Spark meets the others."""
        for f in filters:
            of_item = getattr(f, "attribute", None) == ("item",)
            if of_item and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            if of_item and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            if of_item and isinstance(f, In):
                self.listed = sorted(set(f.value) if self.listed is None else set(f.value) & set(self.listed))
            if not (of_item and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In))):
                yield f

    def asked(self) -> ds.Expression:
        item = ds.field("item")
        asked = (item >= self.first) & (item <= self.last)
        return asked & item.isin(self.listed) if self.listed is not None else asked

    def partitions(self) -> list[Fragment]:
        """Files of the offsets whose statistics allow an asked item: their footers are read, no rows."""
        system, path = opened(self.root)
        found = ds.dataset(path, filesystem=system, format="parquet")
        return [Fragment(f.path) for f in found.get_fragments() if f.subset(self.asked()).row_groups]

    def read(self, partition: Fragment) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        rows = ds.dataset(partition.path, filesystem=system, format="parquet").to_table(filter=self.asked()).sort_by([("file", "ascending"), ("start", "ascending")])
        for batch in rows.to_batches(max_chunksize=10_000):
            files = batch.column("file").dictionary_encode()
            for k, file in enumerate(files.dictionary.to_pylist()):
                own = batch.filter(pa.compute.equal(files.indices, k))
                where, path = opened(file)
                with where.open_input_file(path) as f:
                    spans = list(zip(own.column("start").to_pylist(), own.column("end").to_pylist()))
                    texts = [x.removesuffix(self.brk).decode("utf-8", "replace") for x in read_ranges(f, spans)]
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("file", "item", "start", "end")] + [pa.array(texts, pa.string())], names=["file", "item", "start", "end", "content"])


class ItemRanges(DataSource):
    """`spark.read.format("item_ranges")`. Files and offsets are opened by Arrow in each task: local paths that all
    executors share, and the stores that Arrow knows."""

    @classmethod
    def name(cls) -> str:
        return "item_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ItemReader:
        return ItemReader(self.options)


def items_between(spark: SparkSession, root: str, first: int | None = None, last: int | None = None, brk: str = "\r\n") -> DataFrame:
    """(file, item, start, end, content) of the items first to last, both included, of the files that store_offsets indexed.

    Filters on item are pushed to the source, for which spark.sql.python.filterPushdown.enabled is set in the session. A
    broken character is replaced; an item without a break at the end of its file is whole.
    """
    spark.dataSource.register(ItemRanges)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    known = tables.versions(spark, root)
    if not known:
        raise ValueError(f"no offsets in {root}")
    options = {k: str(v) for k, v in (("first", first), ("last", last)) if v is not None}
    return spark.read.format("item_ranges").option("offsets", f"{root}/v={known[-1]}").option("break", brk).options(**options).load()
