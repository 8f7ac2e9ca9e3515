"""Long words of two letters in the order of Thue and Morse, for which polynomial hashes modulo 2 ** 64 collide, and forced collisions."""

import tracemalloc

import numpy as np
import pytest

from loam.llm import bpe, common, decontaminate, jaccard, substring_dedup


def twin(n, a="a", b="b"):
    """A word and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_hashes_differ(size):
    x, y = (np.frombuffer(w.encode(), np.uint8) for w in twin(size))
    data = np.concatenate((x, y))
    h = common.hashes(data, np.array([0, size, 0, 3]), np.array([size, size, 0, 5]))
    assert len(set(h.tolist())) == 4


def test_hashes_are_of_the_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    start, size = rng.integers(0, 4900, 4000), rng.integers(0, 30, 4000)
    h, seen = common.hashes(data, start, size), {}
    for k, (a, n) in enumerate(zip(start, size)):
        assert seen.setdefault(data[a : a + n].tobytes(), h[k]) == h[k]
    assert len(set(seen.values())) == len(seen)


def encoder():
    import public_tokenizers
    import tiktoken

    r = bpe.ranks(open(bpe.default_ranks(), "rb").read())
    return r, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=r.token, special_tokens={})


def test_bpe_of_twins(spark):
    _, enc = encoder()
    rows = [(i, " ".join(twin(n))) for i, n in enumerate((2048, 1024, 4096))]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), bpe.default_ranks()).collect()}
    assert got == {d: enc.encode_ordinary(t) for d, t in rows}


def test_bpe_with_one_hash_for_all(monkeypatch):
    import pyarrow as pa

    r, enc = encoder()
    monkeypatch.setattr(bpe, "hashes", lambda data, start, size: np.zeros(len(start), np.uint64))
    docs = ["some words and some more", "", "wörds, and\n\n  more 123", "a" * 50]
    ids, bounds = bpe.encode_texts(*common.flat(pa.array(docs)), r)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [enc.encode_ordinary(d) for d in docs]


def test_one_long_word():
    """Merges of a word are a heap's work, not a rebuild each."""
    r, enc = encoder()
    word = "ab" * 20000 + "xyzzy" * 3000
    tracemalloc.start()
    got = bpe.one_word(word.encode(), r)
    assert got == bpe.replay(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]), r)[0].tolist()
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert enc.decode_bytes(got) == word.encode()


def test_decontaminate_twins(spark):
    w, v = twin(1024)
    docs = spark.createDataFrame([(1, f"x {w} y"), (2, f"x {v} y")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, v)], "item_id long, text string")
    got = {r["doc_id"]: (r["hits"], r["items"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: ([], []), 2: ([1], ["7"])}


def test_index_with_one_hash_for_all(monkeypatch):
    """Postings and look-ups when every word has the same first hash."""
    import pyarrow as pa

    real = common.hashes
    same = lambda data, start, size, seed=0: real(data, start, size, seed) if seed else np.zeros(len(start), np.uint64)
    monkeypatch.setattr(common, "hashes", same)
    monkeypatch.setattr(decontaminate, "hashes", same)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["b a c a b"])], names=["doc_id", "text_key", "text"])
    (segment,) = decontaminate.postings(iter([batch]))
    packed = [segment.column(k)[0].as_py() for k in range(4, 8)]
    wanted = decontaminate.Terms(np.frombuffer(b"abz", np.uint8), np.ones(3, np.int64))
    index = decontaminate.Index(np.array([5]), *packed, wanted)
    assert np.split(index.places, index.first[1:-1])[0].tolist() == [1, 3] and index.counts().tolist() == [2, 2, 0]


def test_near_and_substring_keep_twins_apart(spark):
    w, v = twin(1024)
    other = [f"q{i}" for i in range(30)]
    text = lambda x: " ".join([*other[:3], x, *other[3:6], x]) + "."
    docs = spark.createDataFrame([(1, text(w)), (2, text(v))], "doc_id long, text string")
    assert {r["n_links"] for r in jaccard.jaccard_join(docs).collect()} == {0}
    span = lambda x: f"{' '.join(other[:8])} {x}. {' '.join(other[8:20])}."
    docs = spark.createDataFrame([(1, span(w)), (2, span(v)), (3, span(w))], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in substring_dedup.substring_dedup(docs, every=True).collect()}
    assert v in kept[2] and w not in kept[3]
