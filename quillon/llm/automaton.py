"""A trie of reference forms searched with a Levenshtein automaton, many queries at once.

The automaton is universal: a state is the band of edit distances around the diagonal, relative to the
depth in the trie, and the pending transpositions. Its input is which of the query's next characters
equal the trie edge's character. So one table of transitions serves every query, and a step of the
search is an array lookup for all (query, node, state) triples of a level.
"""

from __future__ import annotations

import numpy as np


class Automaton:
    """Distances up to ``most`` with insertions, deletions, substitutions and swaps of neighbours."""

    def __init__(self, most: int):
        k = self.most = most
        self.width = 2 * k + 1  # offsets -k..k
        self.window = 2 * k + 3  # query characters at offsets -k-1..k+1 are compared
        none = k + 1
        start = (tuple(o if o >= 0 else none for o in range(-k, k + 1)), (none,) * self.width)
        known, todo, rows = {start: 1}, [start], [[0] * (1 << self.window)]
        states = [((none,) * self.width, (none,) * self.width), start]
        # where a word was left before its end, only the place itself counts: it was reached with so many edits
        self.landed = [1]
        for edits in range(1, k + 1):
            state = (tuple(min(none, edits + o) if o >= 0 else none for o in range(-k, k + 1)), (none,) * self.width)
            known[state] = len(states)
            states.append(state)
            todo.append(state)
            self.landed.append(known[state])
        while todo:
            row, pend = todo.pop(0)
            out = []
            for bits in range(1 << self.window):
                hit = [bits >> i & 1 for i in range(self.window)]  # hit[i]: offset i - k - 1
                new = []
                for i in range(self.width):
                    best = row[i] + (not hit[i + 1])
                    if i + 1 < self.width:
                        best = min(best, row[i + 1] + 1)
                    if i:
                        best = min(best, new[i - 1] + 1)
                    if pend[i] < none and hit[i]:
                        best = min(best, pend[i] + 1)
                    new.append(min(best, none))
                later = tuple(row[i] if hit[i + 2] and row[i] < k else none for i in range(self.width))
                if min(new) > k and min(later) > k:
                    out.append(0)
                    continue
                state = (tuple(new), later)
                if state not in known:
                    known[state] = len(states)
                    states.append(state)
                    todo.append(state)
                out.append(known[state])
            rows.append(out)
        self.step = np.array(rows, dtype=np.int32)
        self.rows = np.array([s[0] for s in states], dtype=np.int8)
        self.least = np.minimum(self.rows.min(axis=1), np.array([min(s[1]) + 1 for s in states])).astype(np.int8)
        self.least[0] = none


class Trie:
    """Forms with an integer each; forms of different groups hang under different roots."""

    def __init__(self, forms: list[tuple[str, str, int]]):
        """``forms``: (group, form, value); several values at one form are kept."""
        edges: list[dict[str, int]] = []
        ends: list[list[int]] = []

        def node() -> int:
            edges.append({})
            ends.append([])
            return len(edges) - 1

        self.roots: dict[str, int] = {}
        for group, form, value in forms:
            at = self.roots.get(group)
            if at is None:
                at = self.roots[group] = node()
            for sign in form:
                nxt = edges[at].get(sign)
                if nxt is None:
                    nxt = edges[at][sign] = node()
                at = nxt
            ends[at].append(value)
        counts = np.array([len(e) for e in edges], dtype=np.int64)
        self.first = np.append(0, np.cumsum(counts))
        self.child = np.array([c for e in edges for c in e.values()], dtype=np.int32)
        self.sign = np.array([ord(s) for e in edges for s in e], dtype=np.int32)
        self.longest = max((len(form) for _, form, _ in forms), default=0)
        #: letters since the word began, and the words before, at each node
        self.letters, self.word = np.zeros(len(edges), dtype=np.int32), np.zeros(len(edges), dtype=np.int32)
        for at, below in enumerate(edges):  # a node comes before those below it
            for sign, nxt in below.items():
                self.letters[nxt], self.word[nxt] = (0, self.word[at] + 1) if sign == " " else (self.letters[at] + 1, self.word[at])
        self._ends: dict[int, list[int]] = {}
        self.end_first = np.append(0, np.cumsum([len(e) for e in ends]))
        self.values = np.array([v for e in ends for v in e], dtype=np.int64)

    def word_ends(self, at: int) -> list[int]:
        """The nodes below ``at`` where its word ends, ``at`` itself left out."""
        if at not in self._ends:
            found, todo = [], [at]
            while todo:
                node = todo.pop()
                signs = self.sign[self.first[node] : self.first[node + 1]]
                if node != at and (32 in signs or self.end_first[node + 1] > self.end_first[node]):
                    found.append(node)
                todo += self.child[self.first[node] : self.first[node + 1]][signs != 32].tolist()
            self._ends[at] = found
        return self._ends[at]

    def search(self, automaton: Automaton, queries: list[tuple[str, str]], limits: list[int], shortened: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query number, value, distance) with distance <= the query's limit.

        ``queries``: (group, text); a group without forms finds nothing. With ``shortened`` the matches are
        those where a word of the text stands for a longer word of the form: where the text's word ends after
        three letters or more, or after one letter in a later word, the walk goes on at every end of the word below.
        One word at least is not shortened.
        """
        k = automaton.most
        known = [i for i, (group, text) in enumerate(queries) if group in self.roots and len(text) <= self.longest + limits[i]]
        longest = max((len(queries[i][1]) for i in known), default=0)
        text = np.full((len(queries), longest + 2 * k + 4), -1, dtype=np.int32)  # shifted by k + 1
        for i in known:
            q = queries[i][1]
            text[i, k + 1 : k + 1 + len(q)] = np.frombuffer(q.encode("utf-32-le"), dtype=np.int32)
        length = np.array([len(q) for _, q in queries], dtype=np.int64)
        limit = np.array(limits, dtype=np.int8)
        landed = np.array(automaton.landed)
        who = np.array(known, dtype=np.int64)
        node = np.array([self.roots[queries[i][0]] for i in known], dtype=np.int64)
        state = np.ones(len(known), dtype=np.int64)
        at = np.zeros(len(known), dtype=np.int64)  # the text's place that goes with the node
        # some word was shortened; some word was not; a shortened word ends here
        short, whole, ended = (np.zeros(len(known), dtype=bool) for _ in range(3))
        weights, window = 1 << np.arange(automaton.window, dtype=np.int64), np.arange(automaton.window)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            if shortened:
                n, letters = len(who), self.letters[node]
                for shift in range(-k, k + 1):  # the text may be ahead of the node or behind it
                    edits, there = automaton.rows[state[:n], k + shift], at[:n] + shift
                    sign = text[who[:n], np.maximum(there, 0) + k + 1]
                    leave = np.flatnonzero(~ended[:n] & (there > 0) & ((sign == 32) | (there == length[who[:n]])) & (edits <= limit[who[:n]]) & (((letters >= 3) & (letters + shift >= 3)) | ((letters == 1) & (self.word[node[:n]] > 0))))
                    below = [self.word_ends(x) for x in node[leave].tolist()]
                    some = np.array([len(x) for x in below], dtype=np.int64)
                    if some.sum():
                        origin = np.repeat(leave, some)
                        node = np.append(node, np.array([x for each in below for x in each], dtype=np.int64))
                        who, at, whole, state = np.append(who, who[origin]), np.append(at, there[origin]), np.append(whole, whole[origin]), np.append(state, landed[edits[origin]])
                        short, ended = np.append(short, np.ones(len(origin), bool)), np.append(ended, np.ones(len(origin), bool))
            offset = length[who] - at
            near = (np.abs(offset) <= k) & (self.end_first[node + 1] > self.end_first[node])
            if shortened:
                near &= short & (whole | ~ended)
            near = np.flatnonzero(near)
            if len(near):
                gap = automaton.rows[state[near], offset[near] + k]
                near, gap = near[gap <= limit[who[near]]], gap[gap <= limit[who[near]]]
                some = self.end_first[node[near] + 1] - self.end_first[node[near]]
                place = np.repeat(self.end_first[node[near]], some) + _within(some)
                found.append((np.repeat(who[near], some), self.values[place], np.repeat(gap, some)))
            some = self.first[node + 1] - self.first[node]
            # what is longer than its query by more than the limit can't match any more
            some[offset < -limit[who].astype(np.int64)] = 0
            some[at + automaton.window > text.shape[1]] = 0
            edge = np.repeat(self.first[node], some) + _within(some)
            who, state, at = np.repeat(who, some), np.repeat(state, some), np.repeat(at, some)
            bits = (text[who[:, None], at[:, None] + window] == self.sign[edge, None]) @ weights
            state = automaton.step[state, bits].astype(np.int64)
            alive = automaton.least[state] <= limit[who]
            if shortened:
                short, whole, ended = np.repeat(short, some), np.repeat(whole, some), np.repeat(ended, some)
                blank = self.sign[edge] == 32
                alive &= blank | ~ended
                short, whole = short[alive], (whole | (blank & ~ended))[alive]
                ended = np.zeros(len(short), dtype=bool)
            who, state, node, at = who[alive], state[alive], self.child[edge[alive]].astype(np.int64), at[alive] + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        return tuple(np.concatenate(x) for x in zip(*found))


def _within(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """The same distance for two strings; one over ``most`` comes out as most + 1. With ``most`` only the
    band of that width is computed, so long strings take time in proportion to their length."""
    if a == b:
        return 0
    k = max(len(a), len(b)) if most is None else most
    if abs(len(a) - len(b)) > k:
        return k + 1
    far = k + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(k, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            if j == 0:
                new[0] = i
                continue
            d = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before.get(j - 2, far) + 1)
            new[j] = min(d, far)
        before, row = row, new
        if most is not None and min(row.values()) > most:
            return far
    return row.get(len(b), far)
