"""A multi-pattern automaton: a trie with failure links as flat arrays, stepped over many stretches of text at once.

Every byte costs one look-up of a table, whatever the number of patterns. Nothing here depends on Spark: tasks build
it from the terms and run it over their batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of one transition table; patterns of more are dealt to several automata, each of which takes a pass.
TABLE_BYTES = 64 << 20
#: Bytes of a stretch at least. A stretch is entered as many bytes before it as the longest pattern may reach back.
STRETCH = 192


def grouped(words: list[np.ndarray], most: int) -> Iterator[list[int]]:
    """Numbers of the words, in order of their bytes, in groups whose tables have at most `most` entries (one word at least)."""
    order = sorted(range(len(words)), key=lambda k: words[k].tobytes())
    group: list[int] = []
    states, seen, before = 1, np.zeros(256, bool), b""
    for k in order:
        raw = words[k].tobytes()
        common = next((i for i, (a, b) in enumerate(zip(before, raw)) if a != b), min(len(before), len(raw)))
        new = seen.copy()
        new[words[k]] = True
        if group and (states + len(raw) - common) * (int(new.sum()) + 1) > most:
            yield group
            group, states, new, common = [], 1, np.zeros(256, bool), 0
            new[words[k]] = True
        group.append(k)
        states, seen, before = states + len(raw) - common, new, raw
    if group:
        yield group


class Automaton:
    """Patterns are byte strings, not empty and different from each other."""

    def __init__(self, words: list[np.ndarray]):
        self.size = np.array([len(w) for w in words], np.int64)
        used = np.zeros(256, bool)
        used[np.concatenate(words)] = True
        #: Class of each byte: 0 for all that are in no pattern.
        self.kind = np.where(used, np.cumsum(used), 0).astype(np.uint8)
        self.kinds = kinds = int(used.sum()) + 1
        bytes_, start = self.kind[np.concatenate(words)], np.cumsum(self.size) - self.size
        state, levels, n = np.zeros(len(words), np.int64), [], 1
        for depth in range(int(self.size.max())):  # the trie, a level of all words at a time
            on = np.flatnonzero(self.size > depth)
            key, which = np.unique(state[on] * kinds + bytes_[start[on] + depth], return_inverse=True)
            levels.append((key // kinds, key % kinds, n + np.arange(len(key))))
            state[on] = n + which
            n += len(key)
        table, fail = np.zeros((n, kinds), np.int32), np.zeros(n, np.int64)
        word = np.full(n, -1, np.int64)
        word[state] = np.arange(len(words))
        shorter = np.zeros(n, np.int64)  # the longest proper suffix that is a pattern
        for parent, kind, child in levels:
            fail[child] = np.where(parent == 0, 0, table[parent, kind])  # the row is still that of the parent's own failure
            table[parent, kind] = child
            shorter[child] = np.where(word[fail[child]] >= 0, fail[child], shorter[fail[child]])
            # each child goes on as its failure does; that one is shallower, and its row is whole when its children are known
            table[child] = table[fail[child]]
        accepts = (word >= 0) | (shorter > 0)
        order = np.argsort(accepts, kind="stable")  # states at which patterns end come last
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        self.least = int(n - accepts.sum()) * kinds
        self.table = (number[table[order]] * kinds).astype(np.int32).ravel()
        ends = order[accepts[order]]
        lists, at = [], ends
        while len(at):  # patterns that end at a state, the longest first
            lists.append(word[at])
            at = shorter[at]
            if not at.any():
                break
        every = np.stack(lists, axis=1) if lists else np.zeros((0, 1), np.int64)
        some = every >= 0
        self.first = np.r_[0, np.cumsum(some.sum(axis=1))]
        self.words = every[some]

    def ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, byte after its end) of all occurrences in data, in the order of ends, of equal ends the longest first."""
        back = int(self.size.max()) - 1
        stretch = max(STRETCH, 4 * back)
        lanes = max(1, -(-len(data) // stretch))
        kinds = np.zeros(back + lanes * stretch, np.uint8)
        np.take(self.kind, data, out=kinds[back : back + len(data)])
        columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(kinds, (lanes, back + stretch), (stretch, 1)).T)
        states = np.empty((stretch, lanes), np.int32)
        now, at = np.zeros(lanes, np.int32), np.empty(lanes, np.int64)
        for j in range(back + stretch):
            np.add(now, columns[j], out=at)
            now = states[j - back] if j >= back else np.empty(lanes, np.int32)
            np.take(self.table, at, out=now, mode="clip")
        hit = np.flatnonzero((states >= self.least).T.ravel())  # by lane, then place: in the order of the text
        state = (states.T[hit // stretch, hit % stretch] - self.least) // self.kinds
        per = self.first[state + 1] - self.first[state]
        total = int(per.sum())
        place = np.arange(total) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.first[state], per)
        return self.words[place], np.repeat(hit, per) + 1
