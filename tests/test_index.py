"""Stored indexes and ranges: the same rows as a full scan, and what is read for them."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import results, terms, trigrams
from loam.operators.terms import Term
from loam.sources import ranges

TERMS = ([Term("needle")], [Term("needle"), Term("ünder", 1)], [Term("absent")], [Term("ab")], [Term("needle"), Term("ab")], [Term("xyz"), Term("needle")], [])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(40)) for _ in range(200)]
    for i in (17, 18, 150):
        texts[i] += " needle " + word()
    texts[60] += " ünder xyz"
    texts[61] += " need ünde edle"  # some of the trigrams, no term
    rows = [(f"{i:04}", t) for i, t in enumerate(texts)] + [("0200", None), ("0201", ""), ("0202", "x"), (None, "a null uri and a needle")]
    return spark.createDataFrame(rows, "uri string, text string").withColumn("block", F.lit("clash"))


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("asked", TERMS)
def test_indexed_search(spark, corpus, tmp_path_factory, asked, every):
    at = str(tmp_path_factory.mktemp("trigrams"))
    assert trigrams.store(corpus, at, block_bytes=2000, uri_col="uri") > 10
    told = lambda df: sorted(((r["uri"], r["n"], round(r["score"], 9)) for r in df.collect()), key=repr)
    got = trigrams.indexed_search(spark, at, asked, every, min_score=0.0)
    assert told(got) == told(results.search(corpus, asked, 0.0, every, uri_col="uri"))
    files = {f.rsplit("/", 1)[1] for f in got.inputFiles()}
    all_files = spark.read.parquet(f"{at}/texts/v=1").select(F.col("_metadata.file_name").alias("f"), "text")
    where = F.lit(False)
    for t in asked:
        where = where | F.contains("text", F.lit(t.text))
    hits = {r["f"] for r in all_files.where(where).select("f").distinct().collect()}
    if any(len(t.text.encode()) < 3 for t in asked) and not every:
        assert len(files) > 10  # too short to tell
    else:
        assert files <= hits | {r["f"] for r in all_files.where("text LIKE '%ünde%'").select("f").collect()} and (every or hits <= files)


def test_postings_are_numbers(spark, corpus, tmp_path, monkeypatch):
    """Postings hold numbers, not names of files, and are told once a block without a shuffle; every name is in a table."""
    made = trigrams.postings(corpus.select(F.lit(7).cast("long").alias("block"), F.coalesce("text", F.lit("")).alias("text")))
    assert made.dtypes == [("gram", "int"), ("block", "bigint")] and "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    at = str(tmp_path)
    n = trigrams.store(corpus, at, block_bytes=2000, uri_col="uri")
    names = [r["path"] for r in spark.read.parquet(f"{at}/blocks/v=1").collect()]
    texts = spark.read.parquet(f"{at}/texts/v=1").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.collect_list("text").alias("texts"))
    want = {(r["path"], g) for r in texts.collect() for x in r["texts"] for g in trigrams.of_term(x)}
    got = spark.read.parquet(f"{at}/postings/v=1").join(spark.read.parquet(f"{at}/blocks/v=1"), "block")
    assert len(names) == len(set(names)) <= n and {(r["path"], r["gram"]) for r in got.collect()} == want


def test_index_of_nothing(spark, corpus, tmp_path):
    trigrams.store(corpus.where("false"), str(tmp_path), uri_col="uri")
    assert trigrams.indexed_search(spark, str(tmp_path), [Term("needle")], min_score=0.0).count() == 0
    assert trigrams.indexed_search(spark, str(tmp_path), [Term("a")], min_score=0.0).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_corrections(spark, most):
    """The deletion index finds what a comparison with every known word finds, in long words too."""
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abcé日") for _ in range(n))
    known = sorted({word(rng.choice((1, 2, 3, 4, 5, 9, 14, 25))) for _ in range(150)})
    mutated = []
    for _ in range(120):
        w = list(rng.choice(known))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w[i : i + rng.randint(0, 1)] = [rng.choice("abcé日x")] * rng.randint(0, 1)
        mutated.append("".join(w))
    asked = [*mutated, "", "a", "zzzzzz", "x" * 300, None, mutated[0]]
    counts = {k: rng.randint(1, 3) for k in known}
    words, frequencies = spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([*counts.items()], "word string, n long")
    want = {}
    for w in {w for w in asked if w is not None}:
        near = min(((edits(w, k), -n, k.encode()) for k, n in counts.items() if edits(w, k) <= most), default=None)
        want[w] = near[2].decode() if near else w
    got = terms.corrections(words, frequencies, most)
    assert {r["word"]: r["correction"] for r in got.collect()} == want and got.count() == len(want)
    kept = terms.correction_index(frequencies, most)
    assert {r["word"]: r["correction"] for r in terms.corrections(words, frequencies, most, kept).collect()} == want
    assert terms.corrections(words.where("false"), frequencies, most).count() == 0 and terms.corrections(words, frequencies.where("false"), most).where("word <> correction").count() == 0


def test_corrected_search(spark):
    docs = spark.createDataFrame([(1, "a bulgaria energy plan"), (2, "nothing here"), (3, "gari")], "doc_id int, text string")
    known = spark.createDataFrame([("bulgaria", 5), ("energy", 3), ("plan", 1)], "word string, n long")
    correct = terms.corrector(spark, ["bulgraia energy", "plan!"], known)
    assert correct("bulgraia") == "bulgaria" and correct("energy") == "energy" and correct("absent") is None
    found = {r["uri"]: r["n"] for r in results.corrected_search(docs, ["bulgraia"], known, min_score=0.0).collect()}
    assert found.keys() == {"1", "3"}
    assert results.corrected_search(docs, [], known, min_score=0.0).count() == 0


class Counting:
    """A file that tells how many bytes are read."""

    def __init__(self, data):
        self.data, self.at, self.read_bytes = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.read_bytes += len(out)
        return out


def test_only_asked_bytes_are_read():
    file = Counting(bytes(range(256)) * 1000)
    asked = [(10, 20), (20, 25), (40, 41), (200_000, 200_010), (255_990, 256_100)]
    got = list(ranges.read_ranges(file, asked, gap=30))
    assert got == [file.data[a:b] for a, b in asked] and file.read_bytes == 31 + 10 + 10
    assert [len(g) for g in ranges.runs(asked, gap=30, most=12)] == [1, 1, 1, 1, 1] and list(ranges.runs([])) == []


def test_item_ranges(spark, tmp_path):
    """Items by number from several files, with raw breaks, characters of several bytes and no break at the end; only their bytes are opened."""
    files_, want = tmp_path / "in", {}
    files_.mkdir()
    for name, n in (("a", 300), ("b", 120)):
        rows = [f"{i},é日{'x' * (i % 40)}" + ("\r\nmore, é" if i % 3 == 0 else "") for i in range(n)]
        (files_ / name).write_bytes(("key,header\r\n" + "\r\n".join(rows)).encode())
        want[name] = rows
    at = str(tmp_path / "offsets")
    ranges.store_offsets(spark, str(files_), at, r"\d+,", header=True)
    told = lambda df: sorted((r["file"][-1], r["item"], r["content"]) for r in df.collect())
    every = sorted((name, i + 1, t) for name, rows in want.items() for i, t in enumerate(rows))
    assert told(ranges.items_between(spark, at)) == every
    assert told(ranges.items_between(spark, at, 100, 130)) == [x for x in every if 100 <= x[1] <= 130]
    for r in ranges.items_between(spark, at, 299).collect():
        raw = (files_ / r["file"][-1]).read_bytes()
        assert raw[r["start"] : r["end"]].decode().removesuffix("\r\n") == r["content"]
    some = ranges.items_between(spark, at, 5).where("item IN (3, 7, 110, 250) AND content LIKE '%x%'")
    assert told(some) == [x for x in every if x[1] in (7, 110, 250)]
    assert told(ranges.items_between(spark, at).where("item > 118 AND item <= 121")) == [x for x in every if 118 < x[1] <= 121]
    # parts of a file that hold no asked item are not read: they may as well be destroyed
    raw = (files_ / "b").read_bytes()
    kept = raw.index(b"\r\n50,"), raw.index(b"\r\n60,") + 2
    (files_ / "b").write_bytes(b"#" * kept[0] + raw[kept[0] : kept[1]] + b"#" * (len(raw) - kept[1]))
    assert told(ranges.items_between(spark, at, 51, 60).where("file LIKE '%b'")) == [x for x in every if x[0] == "b" and 51 <= x[1] <= 60]
    reader = ranges.ItemReader({"offsets": f"{at}/v=1", "first": "100000"})
    assert reader.partitions() == []  # the footers tell that no file has such items
    with pytest.raises(ValueError):
        ranges.items_between(spark, str(tmp_path / "none"))
