"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import flat, table, texts

# The base patterns and least lengths of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Runs of these characters of at least LEAST characters are candidates of the method.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Parts of a run: '=' is padding at its end alone. Parts that no alphabet holds have separators of two, and are read by each.
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+\Z)?")
FINER = (re.compile(r"[A-Za-z0-9+/]+(?:=+\Z)?"), re.compile(r"[A-Za-z0-9_-]+(?:=+\Z)?"))
LEAST = 20
IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
#: Lower ends of the length classes, encodings from the narrowest alphabet on, and bins of the combined p-value.
LENGTHS = (20, 24, 32, 48, 64, 128)
ENCODINGS = (
    ("decimal", "0123456789"), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"), ("BASE36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_places = [{c: i for i, c in enumerate(a)} for _, a in ENCODINGS]
BINS = 50
#: The false-discovery rate that a length class may have.
RATE = 0.05

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_tail(x: float, freedom: int) -> float:
    """Upper tail of chi-squared, by the cube-root transform."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * freedom)
    return 0.5 * math.erfc(((x / freedom) ** (1 / 3) - (1 - v)) / math.sqrt(2 * v))


def encoding(token: str) -> int | None:
    """Number of the narrowest alphabet that holds the token (padding apart)."""
    body = set(token.rstrip("="))
    return next((k for k, p in enumerate(_places) if body <= p.keys()), None)


def randomness(token: str, kind: int) -> float:
    """Combined p-value of three tests under 'characters drawn evenly from the alphabet'; near 0 for prose.

    Uniformity: chi-squared over eight equal slices of the alphabet. Runs: number of runs above and below the
    alphabet's middle. Serial correlation: of neighbouring symbols. Fisher's sum of the three, six degrees.
    """
    places, size = _places[kind], len(_places[kind])
    x = [places[c] for c in token.rstrip("=") if c in places]
    n = len(x)
    if n < 8:
        return 0.0
    slices = [0] * 8
    shares = [0] * 8
    for i in range(size):
        shares[i * 8 // size] += 1
    for v in x:
        slices[v * 8 // size] += 1
    uniform = chi_tail(sum((o - n * s / size) ** 2 / (n * s / size) for o, s in zip(slices, shares)), 7)
    up = [2 * v >= size for v in x]
    a = sum(up)
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = normal_tail((1 + sum(p != q for p, q in zip(up, up[1:])) - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    else:
        runs = 0.0
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    serial = normal_tail((sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / var + 1 / n) * math.sqrt(n)) if var else 0.0
    return chi_tail(-2 * sum(math.log(max(p, 1e-12)) for p in (uniform, runs, serial)), 6)


def base_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    low = raw.lower()
    out = []
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, encoding, token) of parts of runs that one alphabet holds and that are not letters of one case alone.

    A part that no alphabet holds is cut at '-' and '_', and again at '+' and '/'; such finer parts may overlap.
    """
    out = []
    for m in TOKEN.finditer(text):
        parts = set()
        for part in PART.finditer(m[0]):
            a, t = m.start() + part.start(), part[0]
            if len(t) >= LEAST:
                parts |= {(a, t)} if encoding(t) is not None else {(a + x.start(), x[0]) for p in FINER for x in p.finditer(t) if len(x[0]) >= LEAST}
        for a, t in sorted(parts):
            if not (t.isalpha() and (t[1:].islower() or t.isupper())):
                out.append((a, a + len(t), encoding(t), t))
    return out


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def ordinary(text: str, start: int, end: int, kind: int) -> str | None:
    """Prose of the candidate's length from beside it: the null sample of its length class."""
    places = _places[kind]
    n = end - start
    near = text[max(0, start - 4 * n) : start] + text[end : end + 4 * n]
    body = "".join(c for c in near if c in places)
    return body[:n] if len(body) >= n else None


def with_runs(batches: Iterator[pa.RecordBatch]):
    """(batch, texts' bytes offsets, row numbers that hold a run of LEAST token bytes): plain texts are never decoded."""
    for batch in batches:
        data, offsets = flat(batch.column(1))
        inside = IN_TOKEN[data]
        rows = set()
        for i in range(len(offsets) - 1):
            part = inside[offsets[i] : offsets[i + 1]]
            outside = np.flatnonzero(~part)
            gaps = np.diff(np.concatenate(([-1], outside, [len(part)])))
            if gaps.max() > LEAST:
                rows.add(i)
        yield batch, data, offsets, rows


def thresholds(docs: DataFrame, rate: float = RATE) -> dict[int, float]:
    """Least combined p-value that a token of each length class needs.

    Every candidate of the corpus and, as a sample of the null 'ordinary text', the prose beside it are counted
    by length class and bin of p. Of the cuts at which the estimated share of ordinary text among what passes,
    (null + 1) / passed, is within `rate`, the lowest is taken; a class without such a cut passes nothing.
    At most len(LENGTHS) * BINS rows come to the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(LENGTHS), BINS), np.int64)
        for batch, data, offsets, rows in with_runs(batches):
            for i in rows:
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                for a, b, kind, token in candidates(text):
                    size = length_class(b - a)
                    counts[0, size, min(BINS - 1, int(randomness(token, kind) * BINS))] += 1
                    if prose := ordinary(text, a, b, kind):
                        counts[1, size, min(BINS - 1, int(randomness(prose, kind) * BINS))] += 1
        at = np.argwhere(counts.sum(axis=0) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[0][tuple(at.T)], pa.int64()), pa.array(counts[1][tuple(at.T)], pa.int64())], names=["size", "bin", "seen", "null"])

    rows = docs.mapInArrow(task, "size int, bin int, seen long, null long").groupBy("size", "bin").agg(F.sum("seen").alias("seen"), F.sum("null").alias("null")).collect()
    seen, null = np.zeros((len(LENGTHS), BINS)), np.zeros((len(LENGTHS), BINS))
    for r in rows:
        seen[r["size"], r["bin"]], null[r["size"], r["bin"]] = r["seen"], r["null"]
    passed, wrong = seen[:, ::-1].cumsum(axis=1)[:, ::-1], null[:, ::-1].cumsum(axis=1)[:, ::-1]
    out = {}
    for k in range(len(LENGTHS)):
        good = [j for j in range(1, BINS) if passed[k, j] and (wrong[k, j] + 1) / passed[k, j] <= rate]
        if good:
            out[k] = min(good) / BINS
    return out


def scan_secrets(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: (doc_id, spans by start, then kind as in KINDS; code points, end exclusive).

    Base spans come from the fixed patterns and always stay. Kind `random` adds runs of token characters whose
    inferred encoding looks random to three tests (see randomness) at the cut of their length class (see
    thresholds), where no base span and no longer such run overlaps them. Two passes over the documents, no shuffle of texts.
    Null text is empty and has no spans; repeated rows are scanned each; an empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    cuts = thresholds(rows, rate)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets, runs in with_runs(batches):
            out = []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                low = raw.lower()
                if i not in runs and not any(k in low for k in (b"passw", b"secret", b"token", b"api")):
                    out.append([])
                    continue
                text = raw.decode()
                spans = base_spans(text, raw)
                if i in runs:
                    for a, b, kind, t in sorted(candidates(text), key=lambda x: x[0] - x[1]):
                        if not any(a < e and s < b for _, s, e in spans) and randomness(t, kind) >= cuts.get(length_class(b - a), 2):
                            spans.append(("random", a, b))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "spans"])

    return rows.mapInArrow(task, SCHEMA)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"), count("random"))
