"""Cover trees over unit vectors, and the dual traversal of two of them; in numpy, for the rows that one task holds.

A tree's nodes are nested balls: a node's children cover its points with balls of half its radius (or of the first smaller power of
two that splits it), and the first child has its own centre. Points are stored in tree order, so that a node is a range.
Each node knows the largest distance from its centre to its points, which is what the bounds of the traversal use.
"""

from __future__ import annotations

import numpy as np

#: Rounding of distances that come from cosines: bounds are not trusted closer than this.
SLACK = 1e-6
#: Pairs of a product in single precision are settled one by one in double if fewer than one in so many can count.
RARE = 64
#: Rows of centres that are compared at a time, and rows that look for leaders at a time.
STEP, LEADERS = 512, 256
#: Pairs of nodes with fewer pairs of points than this are compared point by point, many at once.
SMALL, PAIRS = 4_096, 1 << 15
#: Such pairs of nodes, and links, that are held at a time.
MOST_SMALL, MOST_EDGES = 500_000, 500_000
#: A ball of so few points that is wider than this tells too little to be a node: its points are children themselves.
FEW, LOOSE = 32, 0.3
#: Radius below which a node's points are its children.
FINEST = 2.0**-6


def leaders(units: np.ndarray, radius: float) -> np.ndarray:
    """For each row the row that leads it: rows become leaders in order unless one before them is within ``radius``."""
    near = 1 - radius * radius / 2
    own, found = np.full(len(units), -1), np.zeros(0, np.int64)
    for start in range(0, len(units), LEADERS):
        part = units[start : start + LEADERS]
        mine = own[start : start + LEADERS]
        if len(found):
            likeness = part @ units[found].T
            best = likeness.argmax(axis=1)
            covered = likeness[np.arange(len(part)), best] >= near
            mine[covered] = found[best[covered]]
        rest = np.flatnonzero(mine < 0)
        close, fresh = part[rest] @ part[rest].T >= near, []
        free = np.ones(len(rest), bool)
        for k in range(len(rest)):
            if free[k]:
                led = free & close[k]
                led[k] = True
                mine[rest[led]] = start + rest[k]
                free &= ~led
                fresh.append(start + rest[k])
        found = np.concatenate([found, np.array(fresh, np.int64)])
    return own


class Tree:
    """Nodes as arrays: the range of their points, the first of which is the centre, the radius, and the range of their children in ``children``."""

    def __init__(self, units: np.ndarray) -> None:
        self.order = np.arange(len(units))
        nodes: list[list[float]] = [[0, len(units), _radius(units), 0, 0]]
        children: list[int] = []
        open_nodes = [(0, 2.0)]
        units = units.copy()
        while open_nodes:
            node, radius = open_nodes.pop()
            low, high = int(nodes[node][0]), int(nodes[node][1])
            part, own = units[low:high], None
            while radius > FINEST and (own is None or (own == 0).all()):
                radius /= 2
                own = leaders(part, radius)
            if own is None or radius <= FINEST:
                own = np.arange(high - low)
            own = _tight(part, own)
            # the points of a child stand together, its leader first
            move = np.lexsort((np.arange(len(own)) != own, own))
            units[low:high], self.order[low:high] = part[move], self.order[low:high][move]
            heads, sizes = np.unique(own, return_counts=True)
            starts = low + np.cumsum(sizes) - sizes
            nodes[node][3:] = len(children), len(children) + len(heads)
            for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                children.append(len(nodes))
                nodes.append([start, start + size, _radius(units[start : start + size]) if size > 1 else 0.0, 0, 0])
                if size > 1:
                    open_nodes.append((len(nodes) - 1, radius))
        table = np.array(nodes)
        self.single = units.astype(np.float32)
        self.units, self.radius, self.children = units, table[:, 2], np.array(children, np.int64)
        self.low, self.high, self.first, self.last = (table[:, k].astype(np.int64) for k in (0, 1, 3, 4))

    @classmethod
    def of(cls, units: np.ndarray, **nodes: np.ndarray) -> Tree:
        """A tree made before, from its points in its order and its nodes."""
        tree = cls.__new__(cls)
        tree.units, tree.single, tree.order = units, units.astype(np.float32), np.arange(len(units))
        vars(tree).update(nodes)
        return tree


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square leaves its range."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _tight(units: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Leaders of rows, where those of loose groups of few rows lead themselves."""
    wide = np.zeros(len(own))
    np.maximum.at(wide, own, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", units, units[own]))))
    loose = (wide > LOOSE) & (np.bincount(own, minlength=len(own)) <= FEW)
    return np.where(loose[own], np.arange(len(own)), own)


def _radius(units: np.ndarray) -> float:
    return float(distances(units[:1], units).max())


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Links:
    """What a traversal found: how much weight each point links with on the other side, and links enough to connect what is connected."""

    def __init__(self, a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray) -> None:
        self.sums = [np.concatenate([[0], np.cumsum(w[t.order])]) for t, w in ((a, weight_a), (b, weight_b))]
        self.steps = [np.zeros(len(t.order) + 1, np.int64) for t in (a, b)]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.noted = 0
        self.a, self.b = a, b

    def ranges(self, low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> None:
        for steps, low, high, sums, from_, to in ((self.steps[0], low_a, high_a, self.sums[1], low_b, high_b), (self.steps[1], low_b, high_b, self.sums[0], low_a, high_a)):
            np.add.at(steps, low, sums[to] - sums[from_])
            np.add.at(steps, high, sums[from_] - sums[to])

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        """Notes links of points of both sides, numbered on; many of them are replaced by what they connect."""
        self.edges.append((a, b))
        self.noted += len(a)
        if self.noted > MOST_EDGES:
            root = self.roots()
            hung = np.flatnonzero(root != np.arange(len(root)))
            self.edges, self.noted = [(hung, root[hung])], 0

    def roots(self) -> np.ndarray:
        a, b = (np.concatenate([e[k] for e in self.edges]) if self.edges else np.zeros(0, np.int64) for k in (0, 1))
        return connected(a, b, len(self.a.order) + len(self.b.order))

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked weight of the points of a, then of b (as the trees' input was ordered), and the root of each of them."""
        root = self.roots()
        n = len(root)
        counts = [np.zeros(len(t.order), np.int64) for t in (self.a, self.b)]
        place = np.concatenate([self.a.order, self.b.order + len(self.a.order)])
        for out, t, steps in zip(counts, (self.a, self.b), self.steps, strict=True):
            out[t.order] = np.cumsum(steps)[:-1]
        roots = np.empty(n, np.int64)
        roots[place] = place[root]
        return counts[0], counts[1], roots


def connected(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A representative of each node's component, by hooking on smaller ones and jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) that connect what a matrix of links connects; for a dense matrix far fewer than it has."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    first_of_column = linked[:, columns].argmax(axis=0)
    a, b = [rows, first_of_column], [linked[rows].argmax(axis=1), columns]
    # rows that the first links leave apart: all their links
    n, m = linked.shape
    root = connected(np.concatenate(a), np.concatenate(b) + n, n + m)
    if len(np.unique(root[rows])) > 1:
        here, there = np.nonzero(linked & (root[:n, None] != root[None, n:]))
        if len(here):
            _, once = np.unique(root[here] * (n + m) + root[n + there], return_index=True)
            a.append(here[once])
            b.append(there[once])
    return np.concatenate(a), np.concatenate(b)


def traverse(a: Tree, b: Tree, most: float, weight_a: np.ndarray, weight_b: np.ndarray) -> Links:
    """All links of points of ``a`` with points of ``b`` at a distance of ``most`` or less (both directions if they are one tree).

    A pair of nodes is left when their balls are further apart than that, and links as a whole when they are nowhere so
    far apart; else their children meet, down to points. Points themselves are compared by their cosine.
    """
    links = Links(a, b, weight_a, weight_b)
    least = 1 - most * most / 2
    todo, small, held = [(0, 0)], [], 0
    while todo:
        na, nb = todo.pop()
        of_a, of_b = (t.children[t.first[k] : t.last[k]] if t.last[k] > t.first[k] else np.array([k]) for t, k in ((a, na), (b, nb)))
        for ka, kb in ((x, y) for whole in _parts(a, of_a) for x in np.split(whole, range(STEP, len(whole), STEP)) for y in _parts(b, of_b)):
            reach_a, reach_b = a.radius[ka], b.radius[kb]
            far = most + SLACK + reach_a.max() + reach_b.max()
            points = far == most + SLACK
            # no pair below this cosine can be near enough
            floor = least if points else 1 - far * far / 2
            likely = _likely(a, ka, b, kb, floor)
            if points and likely is not None:
                pa, pb = a.low[ka[likely[0]]], b.low[kb[likely[1]]]
                links.ranges(pa, pa + 1, pb, pb + 1)
                links.connect(pa, pb + len(a.order))
                continue
            if likely is None:
                cosines = a.units[a.low[ka]] @ b.units[b.low[kb]].T
                if points:
                    _take(links, cosines >= least, ka, kb)
                    continue
                i, j = np.nonzero(cosines >= floor)
                likely = i, j, cosines[i, j]
            i, j, cosines = likely
            reach, apart = reach_a[i] + reach_b[j], np.sqrt(np.maximum(0, 2 - 2 * cosines))
            whole, split = apart + reach < most - SLACK, apart - reach <= most + SLACK
            if whole.any():
                linked = np.zeros((len(ka), len(kb)), bool)
                linked[i[whole], j[whole]] = True
                _take(links, linked, ka, kb)
            i, j = ka[i[split & ~whole]], kb[j[split & ~whole]]
            pair_points = (a.high[i] - a.low[i]) * (b.high[j] - b.low[j])
            few = pair_points <= SMALL
            todo += zip(i[~few].tolist(), j[~few].tolist(), strict=True)
            small.append((i[few], j[few]))
            held += int(few.sum())
            if held > MOST_SMALL:
                _by_points(links, small, least)
                small, held = [], 0
    _by_points(links, small, least)
    return links


def _likely(a: Tree, ka: np.ndarray, b: Tree, kb: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Pairs of centres with a cosine of ``floor`` or more, and their cosines; None if there may be many.

    The product is made in single precision, whose error on unit vectors is bounded by their width; what it can't rule out is
    settled in double precision.
    """
    if floor <= 0:
        return None
    rough = a.single[a.low[ka]] @ b.single[b.low[kb]].T
    at = np.flatnonzero(rough >= np.float32(floor - (a.units.shape[1] + 8) * 2.0**-23))
    if len(at) * RARE > rough.size:
        return None
    i, j = at // rough.shape[1], at % rough.shape[1]
    cosines = np.einsum("ij,ij->i", a.units[a.low[ka[i]]], b.units[b.low[kb[j]]])
    near = cosines >= floor
    return i[near], j[near], cosines[near]


def _parts(tree: Tree, nodes: np.ndarray) -> list[np.ndarray]:
    """The points and the balls among some nodes."""
    balls = tree.high[nodes] - tree.low[nodes] > 1
    return [part for part in (nodes[~balls], nodes[balls]) if len(part)]


def _by_points(links: Links, small: list[tuple[np.ndarray, np.ndarray]], least: float) -> None:
    """Compares all points of some pairs of nodes, ``PAIRS`` at a time."""
    a, b = links.a, links.b
    na, nb = (np.concatenate([s[k] for s in small]) if small else np.zeros(0, np.int64) for k in (0, 1))
    size_a, size_b = a.high[na] - a.low[na], b.high[nb] - b.low[nb]
    ends = np.cumsum(size_a * size_b)
    start = 0
    while start < len(na):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        sa, sb = size_a[start:stop], size_b[start:stop]
        pairs = sa * sb
        k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        wide = np.repeat(sb, pairs)
        pa, pb = np.repeat(a.low[na[start:stop]], pairs) + k // wide, np.repeat(b.low[nb[start:stop]], pairs) + k % wide
        near = np.einsum("ij,ij->i", a.units[pa], b.units[pb]) >= least
        pa, pb = pa[near], pb[near]
        links.ranges(pa, pa + 1, pb, pb + 1)
        links.connect(pa, pb + len(a.order))
        start = stop


def _take(links: Links, linked: np.ndarray, ka: np.ndarray, kb: np.ndarray) -> None:
    """Counts the linked pairs of nodes of a matrix and connects them."""
    if not linked.any():
        return
    a, b = links.a, links.b
    # weights by sums over rows and columns, so that a full matrix isn't written out as pairs
    own_a, own_b = (s[t.high[k]] - s[t.low[k]] for s, t, k in ((links.sums[0], a, ka), (links.sums[1], b, kb)))
    for steps, t, k, sums in ((links.steps[0], a, ka, linked @ own_b), (links.steps[1], b, kb, own_a @ linked)):
        np.add.at(steps, t.low[k], sums)
        np.add.at(steps, t.high[k], -sums)
    i, j = spanning(linked)
    links.connect(a.low[ka[i]], b.low[kb[j]] + len(a.order))
    for t, nodes, base in ((a, np.unique(ka[i]), 0), (b, np.unique(kb[j]), len(a.order))):
        sizes = t.high[nodes] - t.low[nodes]
        if (sizes > 1).any():
            inner = np.arange(sizes.sum()) + np.repeat(t.low[nodes] - np.cumsum(sizes) + sizes, sizes)
            links.connect(inner + base, np.repeat(t.low[nodes], sizes) + base)
