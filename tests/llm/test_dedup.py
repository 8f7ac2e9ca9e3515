"""Dedup operators against plain versions on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import exact_dedup, jaccard, substring_dedup, suffix_dedup

from loam.operators import components

from .conftest import brute_words


def plain_suffix(rows, width=50):
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if first.setdefault(w, d) < d:
                gone[i : i + width] = b"\1" * width
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[d] = (len(b), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_suffix_dedup(frame, awkward, nothing):
    expected = plain_suffix(awkward)
    got = suffix_dedup.suffix_dedup(frame).collect()
    assert len(got) == len(awkward)
    for r in got:
        assert (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) == expected[r["doc_id"]], r["doc_id"]
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("most", [1, 40])
def test_suffix_dedup_hot_anchors(frame, awkward, most):
    """Anchors with more than `most` runs are cut into windows, over more shares than the session has partitions."""
    expected = plain_suffix(awkward)
    for r in suffix_dedup.suffix_dedup(frame, most=most, share_bytes=20_000).collect():
        assert (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) == expected[r["doc_id"]], r["doc_id"]


def test_suffix_dedup_one_anchor_in_all_rows(spark):
    """A string of 40 bytes in every row, in different surroundings, some of which repeat."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    middle = some(40)
    sides = [(some(30), some(30)) for _ in range(40)]
    rows = [(k, some(20) + a + middle + b + some(20)) for k, (a, b) in enumerate(sides)] + [(100 + k, sides[k][0] + middle + sides[-k][1]) for k in range(20)]
    expected = plain_suffix(rows)
    assert any(v[1] for v in expected.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (5, suffix_dedup.MOST_FRAGMENTS):
        got = {r["doc_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(df, most=most).collect()}
        assert got == expected


def test_hot_runs_are_dealt_by_window():
    """Runs of one anchor in different surroundings have one key; once it is hot, only equal windows do."""
    rng = np.random.default_rng(1)
    middle = rng.integers(97, 123, 40).astype(np.uint8)
    texts = [np.r_[rng.integers(97, 123, 30), middle, rng.integers(97, 123, 30)].astype(np.uint8) for _ in range(50)]
    data, offsets = np.concatenate(texts), np.arange(51) * 100
    runs = suffix_dedup.Runs(data, offsets, 50, 24)
    keys, times = np.unique(runs.key, return_counts=True)
    assert times.max() >= 50
    hot = suffix_dedup.short(keys[times > 5], 7, suffix_dedup.NAME_BYTES)
    start, count, _, key = suffix_dedup.dealt(data, runs, np.arange(len(runs.key)), hot, 7, 50)
    assert count.sum() == runs.count.sum() and sorted(suffix_dedup.ragged(start, count)) == sorted(suffix_dedup.ragged(runs.start, runs.count))
    windows = {}
    for s, n, k in zip(start.tolist(), count.tolist(), key.tolist()):
        windows.setdefault(k, set()).update(data[x : x + 50].tobytes() for x in range(s, s + n))
    assert max(map(len, windows.values())) < 5 * 27


def test_suffix_dedup_ties(spark):
    text = "".join(random.Random(3).choice("abc ") for _ in range(90))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(r["kept"])) for r in suffix_dedup.suffix_dedup(df).collect())
    assert got == [(False, 0, 90), (True, 1, 0), (True, 1, 0), (True, 2, 0)]  # the null id is the least


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.integers(2, 9))
    text = np.concatenate((rng.integers(0, 3, 400).astype(np.uint8), np.zeros(width, np.uint8)))
    wanted = np.flatnonzero(rng.random(400 - width) < 0.6)
    order = suffix_dedup.suffix_order(text, wanted, width)
    keys = [text[i : i + width].tobytes() for i in order]
    assert sorted(order.tolist()) == wanted.tolist() and keys == sorted(keys)
    prefix = suffix_dedup.common_prefixes(text, order, width)
    for a, b, n in zip(keys, keys[1:], prefix[1:]):
        assert a[:n] == b[:n] and (n == width or a[n] != b[n])


def plain_sentences(text):
    b = (text or "").encode()
    words = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", b))
    units = []
    for k, m in enumerate(words):
        gap = b[words[k - 1].end() : m.start()] if k else b""
        if not k or b"\n" in gap or re.search(rb"[.!?][\t\n\x0b\x0c\r ]", gap):
            units.append([])
        units[-1].append(m)
    return b, units


def plain_substring(rows):
    first, parts = {}, {}
    for d, t in rows:
        b, units = plain_sentences(t)
        spans = []
        for i in range(len(units)):
            e, w = i, []
            while e < len(units) and (len(w) < substring_dedup.WORDS or e - i < substring_dedup.SENTENCES):
                w += [m[0].lower() for m in units[e]]
                e += 1
            if len(w) >= substring_dedup.WORDS and e - i >= substring_dedup.SENTENCES:
                spans.append((i, e, tuple(w)))
        parts[d] = (b, units, spans)
        for s in spans:
            first[s[2]] = min(first.get(s[2], d), d)
    out = {}
    for d, (b, units, spans) in parts.items():
        gone, seen = set(), set()
        for i, e, k in spans:
            if first[k] < d or k in seen:
                gone |= set(range(i, e))
            seen.add(k)
        at = [u[0].start() for u in units] + [len(b)]
        if units:
            at[0] = 0
        out[d] = (len(units), len(gone), b"".join(b[at[i] : at[i + 1]] for i in range(len(units)) if i not in gone) if units else b)
    return out


def test_substring_dedup(frame, awkward, nothing):
    expected = plain_substring(awkward)
    got = substring_dedup.substring_dedup(frame).collect()
    assert len(got) == len(awkward)
    for r in got:
        assert (r["n_sentences"], sum(x["last"] - x["first"] + 1 for x in r["removed"]), r["kept"].encode()) == expected[r["doc_id"]], r["doc_id"]
    assert sum(e[1] for e in expected.values()) > 50
    assert substring_dedup.substring_dedup(nothing).count() == 0


def plain_every_run(rows, split=plain_sentences):
    """Rows in the order of their ids: sentences, and those that a non-first run covers, all runs enumerated."""
    first, out = {}, {}
    for d, t in rows:
        units = [[m[0].lower() for m in u] for u in split(t)[1]]
        gone, seen = set(), set()
        for i in range(len(units)):
            words = []
            for e in range(i + 1, len(units) + 1):
                words += units[e - 1]
                if len(words) >= substring_dedup.WORDS and e - i >= substring_dedup.SENTENCES:
                    k = tuple(words)
                    if first.setdefault(k, d) < d or k in seen:
                        gone |= set(range(i, e))
                    seen.add(k)
        out[d] = (len(units), gone)
    return out


def removed_sentences(rows):
    return {r["doc_id"]: (r["n_sentences"], {i for x in r["removed"] for i in range(x["first"], x["last"] + 1)}) for r in rows}


def test_substring_dedup_every_run(spark):
    """Pieces of 10, 10 and 3 words: the last is in no shortest run from a start, but in a run."""
    rng = random.Random(5)
    prose = lambda sizes: " ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "." for n in sizes)
    tail = prose([10, 10, 3])
    passage = prose([4, 9, 2, 7, 1, 8, 1])
    rows = [(1, tail), (2, tail), (3, f"{prose([5])} {passage} {prose([6, 2])}"), (4, f"{prose([3, 9])} {passage} {prose([4])} {passage}"), (5, prose([1, 1, 15, 1])), (6, passage)]
    rows += [(10 + i, f"{prose(rng.choices(range(1, 12), k=3))} {passage[: rng.randrange(150, 260)].rsplit('.', 1)[0]}. {prose([2])}") for i in range(20)]
    got = removed_sentences(substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), every=True).collect())
    assert got == plain_every_run(rows)
    assert got[2] == (3, {0, 1, 2})


def test_substring_dedup_long_sentences(spark):
    """Repeats without marks, a long sentence between others, and scripts without blanks or ASCII marks."""
    rng = random.Random(7)
    w = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    chars = lambda a, n, mark: "".join(chr(a + rng.randrange(60)) + (mark if i % 9 == 8 else "") for i in range(n))
    copies = [w(160), w(384), w(16), chars(0x4E00, 60, "。"), chars(0x4E00, 40, ""), chars(0xE01, 50, ""), "، ".join(f"كلمة{i} نص{i}" for i in range(12)), "। ".join(f"शब्द{i} पाठ{i}" for i in range(12)), "\u3000".join(f"é{i}" for i in range(30))]
    passages = [w(52) for _ in range(30)]
    sentence = w(17)
    rows = [(i * 1000 + k, t) for k, t in enumerate(copies) for i in (1, 2)]
    rows += [(i * 1000 + 100 + k, f"{w(rng.randrange(1, 40))} {p} {w(rng.randrange(1, 40))}") for k, p in enumerate(passages) for i in (1, 2)]
    rows += [(i * 1000 + 200, f"{w(6)}. {sentence}. {w(7)}.") for i in (1, 2)]
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), every=True).collect()}
    texts = dict(rows)
    assert all(got[d] == t for d, t in rows if d < 2000)
    assert [got[2000 + k] for k in range(len(copies))] == [""] * len(copies)
    assert not set(sentence.split()) & set(re.findall(r"\w+", got[2200])) and len(got[2200].split()) == 13
    for k, p in enumerate(passages):
        gone = set(texts[2100 + k].split()) - set(got[2100 + k].split())
        assert len(gone) >= 16 and gone <= set(p.split()), k


def test_exact_dedup(frame, awkward, nothing, spark):
    groups = defaultdict(list)
    for d, t in awkward:
        groups[t or ""].append(d)
    got = exact_dedup.exact_dedup(frame).collect()
    assert len(got) == len(awkward)
    for r in got:
        text = dict(awkward)[r["doc_id"]] or ""
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(groups[text]), len(groups[text]), r["doc_id"] == max(groups[text]), hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.exact_dedup(nothing).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["kept"], r["group_size"]) for r in exact_dedup.exact_dedup(twice).collect()) == [(0, False, 3), (0, True, 1), (1, True, 3), (1, True, 3)]


def test_directory_doubles(spark):
    """A small capacity makes buckets split; every slot points to the bucket of its prefix, and none is overfull."""
    keys = spark.range(500).select(F.xxhash64("id").alias("h"))
    slots, bits = exact_dedup.directory(keys, capacity=40)
    rows = slots.collect()
    assert bits > 4 and sorted(r["slot"] for r in rows) == list(range(1 << bits))
    for r in rows:
        assert r["slot"] >> (bits - r["local_bits"]) << (bits - r["local_bits"]) == r["bucket"]
    held = exact_dedup.located(keys, slots, bits).groupBy("bucket").count().collect()
    assert max(r["count"] for r in held) <= 40 and sum(r["count"] for r in held) == 500
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    sent, joined = (exact_dedup.exact_dedup(docs, capacity=16, sent_bits=b).select("doc_id", "kept", "bucket", "chain").collect() for b in (16, 1))
    assert sorted(sent) == sorted(joined) and all(r["kept"] for r in sent) and len({r["bucket"] for r in sent}) > 16


def test_chains_of_one_key(spark):
    """Five keys for all texts: every bucket's chain holds many texts, each a group of its own; without the directory nothing is found."""
    docs = spark.createDataFrame([(i, f"text {i % 37}") for i in range(111)], "doc_id long, text string")
    key = lambda t: F.xxhash64(F.pmod(F.xxhash64(t), F.lit(5)))
    got = exact_dedup.exact_dedup(docs, capacity=2, key=key).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(i, 74 + i % 37, 3, i >= 74) for i in range(111)]
    assert len({(r["keep_id"], r["bucket"], r["chain"]) for r in got}) == 37 and max(r["chain"] for r in got) > 3
    whole = exact_dedup.directory
    try:
        exact_dedup.directory = lambda keys, capacity: (whole(keys, capacity)[0].where("false"), 0)
        assert exact_dedup.exact_dedup(docs, key=key).count() == 0
    finally:
        exact_dedup.directory = whole


def plain_jaccard(rows, t=0.8):
    sets, where = {}, defaultdict(list)
    for d, text in rows:
        w = brute_words(text)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in sets[d]:
            where[x].append(d)
    links = defaultdict(set)
    for d, s in sets.items():
        if not s:
            continue
        for e, k in Counter(e for x in s for e in where[x] if e != d).items():
            if k >= t * (len(s) + len(sets[e]) - k) - 1e-9:
                links[d].add(e)
    label = {d: d for d in sets}
    while True:
        new = {d: min([label[d], *(label[e] for e in links[d])]) for d in sets}
        if new == label:
            return {d: (label[d], len(links[d]), len(sets[d])) for d in sets}
        label = new


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard(frame, awkward, nothing, block):
    expected = plain_jaccard(awkward)
    got = jaccard.jaccard_join(frame, block=block).collect()
    assert len(got) == len(awkward)
    for r in got:
        assert (r["class_id"], r["n_links"], r["n_shingles"]) == expected[r["doc_id"]], r["doc_id"]
    if block == 4:
        assert jaccard.jaccard_join(nothing).count() == 0


def test_jaccard_recall(spark):
    """Pairs of texts at the threshold and above it: every link is found."""
    rng = random.Random(21)
    rows = []
    for k in range(300):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice((12, 40, 120, 300)))]
        n = len(w) - 4
        most = int(n * (1 - 0.8) / (1 + 0.8))  # shingles that may differ on each side
        changed = list(w)
        for i in range(rng.randint(0, max(0, most // 5))):
            changed[5 * i + 2] = f"x{rng.randint(0, 10**6)}"
        tail = changed + [f"t{k}_{i}" for i in range(rng.randint(0, 2))]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(tail))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_shingles"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = plain_jaccard(rows)
    assert got == expected and sum(e[1] for e in expected.values()) > 400


def test_jaccard_chain(spark):
    """Texts of a chain, each linked to its neighbours alone: far fewer pairs are compared than the group has."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(words[7 * i : 7 * i + 100])) for i in range(200)]
    expected = plain_jaccard(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_shingles"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and {c for c, _, _ in got.values()} == {0}
    sketches = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("doc_id").alias("d"), F.lit(0).cast("long"), "text").mapInArrow(jaccard.sketch, jaccard.SKETCH)
    sizes = jaccard.buckets(sketches.withColumnRenamed("row", "rep")).select("key", "size").distinct().collect()
    assert sum(r["size"] * (r["size"] - 1) // 2 for r in sizes) < 200 * 199 // 2 // 2


def test_jaccard_ids(spark):
    """Null and repeated ids: every row is judged by its own text."""
    rng = random.Random(30)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (2, a + " more"), (1, b), (3, b + " more"), (None, c), (None, c + " more"), (4, d), (None, d), (5, None), (None, ""), (6, text()), (6, text()), (7, a), (7, a)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = {r["text_key"]: r["t"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("text_key")).collect()}
    told = sorted(((r["doc_id"], key[r["text_key"]], r["class_id"], r["n_links"]) for r in got), key=repr)
    want = [(1, a, 1, 3), (2, a + " more", 1, 3), (7, a, 1, 3), (7, a, 1, 3), (1, b, 1, 1), (3, b + " more", 1, 1), (None, c, None, 1), (None, c + " more", None, 1), (4, d, 4, 1), (None, d, 4, 1), (5, "", 5, 0), (None, "", None, 0), (6, rows[10][1], 6, 0), (6, rows[11][1], 6, 0)]
    assert told == sorted(want, key=repr)
    kept = sorted(((r["doc_id"], key[r["text_key"]]) for r in got if r["kept"]), key=repr)
    assert [x for x in kept if x[1] not in (c, c + " more")] == sorted([(1, a), (1, b), (4, d), (5, ""), (None, ""), (6, rows[10][1]), (6, rows[11][1])], key=repr)
    assert sum(x[1] in (c, c + " more") for x in kept) == 1


def test_jaccard_many_links(spark):
    """A large group of near copies over several blocks, whose pairs go through the product of sets."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=40).collect()
    expected = plain_jaccard(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_shingles"]) for r in got} == expected


def test_posterior_bound():
    fewest = jaccard.least_matches(0.8, 1e-9)
    assert max(fewest) == jaccard._n and fewest[jaccard._n] < 0.8 * jaccard._n and all(fewest[a] <= fewest[b] for a, b in zip(sorted(fewest), sorted(fewest)[1:]))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent if find(x) != x}
