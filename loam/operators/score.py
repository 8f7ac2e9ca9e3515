"""Relevance scores over matches (pos, term, order) and a text length: as column expressions, and of whole batches inside a task."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.operators.match import Finder, Found

#: Weight of a match that may be partial, and characters from the first match of a cluster to its last.
PENALTY, WINDOW = 0.9, 50


def by_order(matches: Column, weight) -> Column:
    """Sum of weight(order) over the matches: counts of each order first, so that the sum does not depend on their sequence."""
    orders = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["order"])))
    return F.aggregate(orders, F.lit(0.0), lambda a, o: a + weight(o) * F.size(F.filter(matches, lambda m: m["order"] == o)).cast("double"))


def unique_terms(matches: Column) -> Column:
    return F.size(F.array_distinct(F.transform(matches, lambda m: m["term"]))).cast("long")


def clusters(matches: Column, window: int = WINDOW) -> Column:
    """Clusters of positions; a position more than `window` after its cluster's first begins a new one."""
    ps = F.array_sort(F.transform(matches, lambda m: m["pos"]))
    start = F.struct(F.lit(1).cast("long").alias("n"), F.element_at(ps, 1).alias("first"))
    folded = F.aggregate(F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), start, lambda a, p: F.when(p - a["first"] > window, F.struct((a["n"] + 1).alias("n"), p.alias("first"))).otherwise(a), lambda a: a["n"])
    return F.when(F.size(ps) == 0, F.lit(0).cast("long")).otherwise(folded)


def basic(matches: Column, length: Column) -> Column:
    n = F.size(matches).cast("double")
    spread = F.when(length > 0, 1 + F.least(F.lit(1.0), n / length)).otherwise(F.lit(1.0))
    return F.when(F.size(matches) == 0, F.lit(0.0)).otherwise(by_order(matches, lambda o: F.pow(F.lit(10.0), -o.cast("double"))) * F.sqrt(unique_terms(matches).cast("double")) * spread)


def improved(matches: Column, length: Column, penalty: float = PENALTY, window: int = WINDOW) -> Column:
    """Weights of the orders, unique terms, coverage, closeness and distribution, multiplied."""
    n = F.size(matches).cast("double")
    share = F.when(length > 0, n / length).otherwise(F.lit(0.0))
    weights = by_order(matches, lambda o: F.lit(penalty) / (o.cast("double") + 1))
    close = 1 + 1 / clusters(matches, window).cast("double")
    whole = weights * F.sqrt(unique_terms(matches).cast("double")) * (1 + share) * close * (1 + F.least(F.lit(1.0), share))
    return F.when(F.size(matches) == 0, F.lit(0.0)).otherwise(whole)


def without_noise(matches: Column, markers: Iterable[str]) -> Column:
    """Matches whose term, in lower case, holds none of the markers."""
    markers = list(markers)

    def clean(m: Column) -> Column:
        ok = F.lit(True)
        for marker in markers:
            ok = ok & ~F.contains(F.lower(m["term"]), F.lit(marker))
        return ok

    return F.filter(matches, clean) if markers else matches


def advanced(matches: Column, length: Column, penalty: float = PENALTY, window: int = WINDOW, noise: Iterable[str] = ()) -> Column:
    """The score used by searches: improved(), after noise is filtered; 0 if nothing is left."""
    return improved(without_noise(matches, noise), length, penalty, window)


def cluster_counts(doc: np.ndarray, pos: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """clusters() of n texts: from each cluster's first place, one step to the first place beyond its window."""
    key = np.sort(doc * np.int64(1 << 33) + pos)
    beyond = np.searchsorted(key, key + window, side="right").tolist()
    bounds = np.searchsorted(key, np.arange(n + 1) * np.int64(1 << 33)).tolist()
    out = np.zeros(n, np.int64)
    for d in range(n):
        at, end, count = bounds[d], bounds[d + 1], 0
        while at < end:
            at, count = beyond[at], count + 1
        out[d] = count
    return out


def of_texts(find: Finder, found: Found, noise: Iterable[str] = (), penalty: float = PENALTY, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(distinct terms, advanced score) of each text of a batch: what the column expressions give, from the matches in place."""
    n = len(found.length)
    noise = list(noise)
    clean = np.array([not any(x in t.text.lower() for x in noise) for t in find.terms], bool) if noise else np.ones(len(find.terms), bool)
    keep = clean[found.term] if len(found.term) else np.zeros(0, bool)
    doc, term, pos = found.doc[keep], found.term[keep], found.pos[keep]

    def distinct(doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        if n * len(find.terms) <= 8 * len(doc) + (1 << 16):
            return np.count_nonzero(np.bincount(doc * len(find.terms) + term, minlength=n * len(find.terms)).reshape(n, -1), axis=1)
        return np.bincount(np.unique(doc * np.int64(len(find.terms)) + term) // len(find.terms), minlength=n)

    count = np.bincount(doc, minlength=n).astype(float)
    weights = np.zeros(n)
    orders = find.order[term]
    for o in np.unique(orders).tolist():
        weights += penalty / (o + 1.0) * np.bincount(doc[orders == o], minlength=n)
    share = np.divide(count, found.length, out=np.zeros(n), where=found.length > 0)
    some = count > 0
    unique = distinct(doc, term) if find.terms else np.zeros(n, np.int64)
    close = 1 + 1 / np.maximum(cluster_counts(doc, pos, n, window), 1)
    score = np.where(some, weights * np.sqrt(unique) * (1 + share) * close * (1 + np.minimum(1.0, share)), 0.0)
    if noise and find.terms:
        unique = distinct(found.doc, found.term)
    return unique, score
