"""What is counted around the projects of a citation graph, in one task over arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NAMES = ("in_degree", "out_degree", "self_in_degree", "self_out_degree", "two_hop_in_degree", "cross_author_downstream", "distinct_prior_authors")
STEP = 2_000_000  # about so many pairs are made distinct at a time; the result doesn't depend on it


def counted(batches: Iterator[pa.RecordBatch], heavy: int) -> Iterator[pa.RecordBatch]:
    """pid and the NAMES, of rows (edge, a, b): citations from a to b where ``edge``, else a project a with
    an author b; none null, all of the graph. Rows may repeat."""
    parts: dict[str, list[pa.Array]] = {k: [] for k in ("src", "dst", "pid", "aid")}
    for batch in batches:
        for keys, mask in ((("src", "dst"), batch.column(0)), (("pid", "aid"), pc.invert(batch.column(0)))):
            some = batch.filter(mask)
            parts[keys[0]].append(some.column(1))
            parts[keys[1]].append(some.column(2))
    if not sum(map(len, parts["src"])):
        return
    at, names = numbered(parts.pop("src") + parts.pop("dst"))
    n = len(names)
    s, d = _pairs(*np.split(at, 2), n)
    # the authors of these projects alone; ``who`` goes by project
    of = pc.index_in(pa.concat_arrays([c.cast(names.type) for c in parts.pop("pid")]), value_set=names)
    there = of.is_valid().to_numpy(zero_copy_only=False)
    a, people = numbered(parts.pop("aid"))
    p, who = _pairs(of.drop_null().to_numpy().astype(np.int64), a[there], max(1, len(people)))
    many = np.bincount(p, minlength=n)
    begin = np.cumsum(many) - many
    shared = _shared(s, d, p, who, begin, many)
    loose = ~shared
    both = loose & (many[s] > 0) & (many[d] > 0)
    counts = [np.bincount(end[which], minlength=n) for end, which in ((d, loose), (s, loose), (d, shared), (s, shared))]
    counts.append(two_hop(s[loose], d[loose], n, heavy))
    counts += [distinct(near[both], begin[far[both]], many[far[both]], who, n) for near, far in ((d, s), (s, d))]
    for i in range(0, n, 100_000):
        yield pa.record_batch([names[i : i + 100_000].cast(pa.string()), *(pa.array(c[i : i + 100_000].astype(np.int64)) for c in counts)], names=["pid", *NAMES])


def numbered(chunks: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """The number of each value, and the values."""
    coded = pa.concat_arrays([c.cast(pa.large_string()) for c in chunks]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _pairs(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in their order; b is below ``width``."""
    keys = np.sort(a * width + b)
    keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    return keys // width, keys % width


def _listed(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each row, as many as it has, one row after the other."""
    ends = np.cumsum(many)
    return np.repeat(begin - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


def _steps(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows that list about STEP places, one row at least."""
    ends, i = np.cumsum(many), 0
    while i < len(many):
        j = max(i + 1, int(ends.searchsorted((ends[i - 1] if i else 0) + STEP, side="right")))
        yield i, j
        i = j


def _shared(s: np.ndarray, d: np.ndarray, p: np.ndarray, who: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each edge whether its ends have an author in common."""
    width = int(who.max(initial=0)) + 1
    known, out = p * width + who, np.zeros(len(s), dtype=bool)
    # the end with fewer authors asks for each whether the other has it
    less = many[s] <= many[d]
    x, y = np.where(less, s, d), np.where(less, d, s)
    asked = np.flatnonzero(many[x] > 0)
    for i, j in _steps(many[x[asked]]):
        rows = asked[i:j]
        k = many[x[rows]]
        keys = np.repeat(y[rows], k) * width + who[_listed(begin[x[rows]], k)]
        found = known[np.minimum(known.searchsorted(keys), len(known) - 1)] == keys
        out[np.repeat(rows, k)[found]] = True
    return out


def distinct(owner: np.ndarray, begin: np.ndarray, many: np.ndarray, items: np.ndarray, n: int, kept: Callable | None = None) -> np.ndarray:
    """For each owner below n the number of distinct items that its rows list, a row those from ``begin``, as
    many as it has; of these what ``kept`` (owners, items) tells."""
    by = np.argsort(owner, kind="stable")
    owner, begin, many = owner[by], begin[by], many[by]
    out, width, i = np.zeros(n, dtype=np.int64), int(items.max(initial=0)) + 1, 0
    ends = np.cumsum(many)
    while i < len(owner):
        j = max(i + 1, int(ends.searchsorted((ends[i - 1] if i else 0) + STEP, side="right")))
        j = int(owner.searchsorted(owner[j - 1], side="right"))  # with all rows of its last owner
        o, x = _pairs(np.repeat(owner[i:j], many[i:j]), items[_listed(begin[i:j], many[i:j])], width)
        o = o if kept is None else o[kept(o, x)]
        out += np.bincount(o, minlength=n)
        i = j
    return out


def _classes(node: np.ndarray, mid: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the edges between nodes and heavy projects: the class of each node, -1 without an edge, and the heavy
    projects of each class. Nodes of one class have the same ones."""
    by = np.lexsort((mid, node))
    node, mid = node[by], mid[by]
    of, seen = np.full(n, -1, dtype=np.int64), {}
    first = np.flatnonzero(np.diff(node, prepend=-1))
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(node)]):
        of[node[i]] = seen.setdefault(mid[i:j].tobytes(), len(seen))
    return of, [np.frombuffer(k, dtype=mid.dtype) for k in seen]


def two_hop(s: np.ndarray, d: np.ndarray, n: int, heavy: int) -> np.ndarray:
    """For each node the number of distinct nodes two of the distinct edges away, not the node itself; the edges
    go by s. As ``edges.two_hop_numbers``: what meets over a heavy node meets by classes."""
    inward, outward = np.bincount(d, minlength=n), np.bincount(s, minlength=n)
    over = inward * outward >= heavy
    fc, far = _classes(s[over[d]], d[over[d]], n)
    pids, near = _classes(d[over[s]], s[over[s]], n)
    size = np.bincount(fc[fc >= 0], minlength=len(far))
    at: dict[int, list[int]] = {}
    for c, mids in enumerate(far):
        for m in mids.tolist():
            at.setdefault(m, []).append(c)
    of_mid = {m: np.array(c, dtype=np.int64) for m, c in at.items()}

    def reached(c: int) -> np.ndarray:
        """Which far classes the class reaches."""
        out = np.zeros(len(far), dtype=bool)
        for m in near[c].tolist():
            if m in of_mid:
                out[of_mid[m]] = True
        return out

    def met(nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether the node is reached from the other over a heavy one."""
        out = np.zeros(len(nodes), dtype=bool)
        some = np.flatnonzero((pids[nodes] >= 0) & (fc[others] >= 0))
        some = some[np.argsort(pids[nodes[some]], kind="stable")]
        cs = pids[nodes[some]]
        first = np.flatnonzero(np.diff(cs, prepend=-1))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(cs)]):
            out[some[i:j]] = reached(int(cs[i]))[fc[others[some[i:j]]]]
        return out

    whole = np.array([int(size[reached(c)].sum()) for c in range(len(near))] + [0], dtype=np.int64)[pids]
    whole -= met(np.arange(n), np.arange(n))  # the node itself
    # the paths over the others: each edge from a middle lists what cites the middle
    light = ~over[s]
    mid, node = s[light], d[light]
    by = np.argsort(d, kind="stable")
    begin = np.cumsum(inward) - inward
    return whole + distinct(node, begin[mid], inward[mid], s[by], n, lambda o, x: (o != x) & ~met(o, x))
