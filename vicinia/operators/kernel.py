"""Distances of one block of points to another, in numpy. Sums run from the first dimension to the last, as in the column form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Distances held at once.
STRIP = 1 << 21
#: Pairs of a query and a node looked at together.
FRONTIER = 1 << 17
#: Queries, points and least points of a product of matrices, and the least points that are worth one.
TALL, BROAD, NARROW, LEAST = 512, 4096, 1024, 256
#: Points of a leaf of a block's index, and queries that go through it together.
LEAF = 32


def square_distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(len(q), len(p)) squared distances, in the precision of the inputs."""
    out = np.zeros((len(q), len(p)), q.dtype)
    for j in range(q.shape[1]):
        gap = q[:, j, None] - p[None, :, j]
        gap *= gap
        out += gap
    return out


def within(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, squared distance) of the pairs within `bound`, one a query, in order of (row, distance, id); the first `k` of each query."""
    out = []
    step = max(1, STRIP // max(1, len(p)))
    for start in range(0, len(q), step):
        d = square_distances(q[start : start + step], p)
        limit = np.full(len(d), np.inf) if bound is None else bound[start : start + step].astype(float)
        if k is not None and len(p) > k:
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        rows, cols = np.nonzero(d <= limit[:, None])
        own, near = ids[cols], d[rows, cols]
        order = np.lexsort((own, near, rows))
        rows, own, near = rows[order], own[order], near[order]
        if k is not None:
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, own, near = rows[place < k], own[place < k], near[place < k]
        out.append((rows + start, own, near))
    if not out:
        return np.zeros(0, np.int64), ids[:0], np.zeros(0, q.dtype)
    return tuple(np.concatenate(x) for x in zip(*out))


def exact_pairs(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The squared distance of each row of `q` to the row of `p` in the same place, summed as in `square_distances`."""
    gaps, out = q - p, np.zeros(len(q), q.dtype)
    gaps *= gaps
    for j in range(q.shape[1]):
        out += gaps[:, j]
    return out


def _firsts(rows: np.ndarray, own: np.ndarray, near: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs in order of (row, distance, id), the first `k` of each row."""
    order = np.lexsort((own, near, rows))
    rows, own, near = rows[order], own[order], near[order]
    if k is not None:
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, own, near = rows[first], own[first], near[first]
    return rows, own, near


def filtered_within(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `within`, for many dimensions: products of matrices in 32 bits tell which pairs may lie within the bound and the k-th
    distance so far, and only of these distances are formed.

    A product is off by no more than `slack` of what both rows' squares and the bound sum to (the usual bound of a sum of
    products in any order, for rows that are rounded to 32 bits, twice what it need be), so no pair is lost by rounding.
    """
    if len(p) < LEAST or not len(q):
        return within(q, p, ids, k, bound)
    middle = p.mean(0, dtype=float)
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = q - middle, p - middle
        largest = max(np.abs(a).max(), np.abs(b).max())
    usual = 1e-12 if q.dtype == np.float32 else 1e-100
    if not usual < largest < 1 / usual:  # squares might leave the range of numbers
        return within(q, p, ids, k, bound)
    dims, scale = q.shape[1], 2.0 ** -np.frexp(largest)[1]  # all coordinates at most 1, exactly scaled
    slack, least = 2.0**-23 * (dims + 16), 1e-30 + (1e-36 * dims * scale**2 if q.dtype == np.float32 else 0)
    a, b = (a * scale).astype(np.float32), (b * scale).astype(np.float32)
    a_sq, b_sq = (np.einsum("ij,ij->i", x, x, dtype=float) for x in (a, b))
    right = np.column_stack([b, b_sq * (1 - slack), np.ones(len(b))]).astype(np.float32)  # rows (p, p p, 1) meet (-2 q, 1, q q - limit)
    products, told, out = np.empty(TALL * BROAD, np.float32), np.empty(TALL * BROAD, bool), []

    def product(left: np.ndarray, tile: slice) -> np.ndarray:
        shape = len(left), tile.stop - tile.start
        return np.matmul(left, right[tile].T, out=products[: shape[0] * shape[1]].reshape(shape))

    for start in range(0, len(q), TALL):
        mine = slice(start, min(start + TALL, len(q)))
        n = mine.stop - mine.start
        left = np.column_stack([-2 * a[mine], np.ones(n), np.zeros(n)]).astype(np.float32)
        limit = np.full(n, np.inf) if bound is None else bound[mine].astype(float)
        found = np.zeros(0, np.int64), ids[:0], np.zeros(0, q.dtype)
        waiting, total, at = [], 0, 0
        while at < len(p):
            tile = slice(at, min(at + (BROAD if k is None else min(max(NARROW, 4 * k, at), BROAD)), len(p)))
            if at == 0 and k is not None and k <= tile.stop and np.isinf(limit).any():  # the k-th of the first products, and what they may be off
                left[:, dims + 1] = a_sq[mine] * (1 - slack)
                kth = np.partition(product(left, tile), k - 1, axis=1)[:, k - 1].astype(float)
                reach = (kth + 2 * slack * (a_sq[mine] + b_sq[tile].max()) + least) * (1 + slack)
                limit = np.minimum(limit, np.maximum(reach, 0) / scale**2)
            scaled = np.minimum(limit * scale**2, 1e30)
            left[:, dims + 1] = a_sq[mine] * (1 - slack) - scaled * (1 + slack) - least
            own = product(left, tile)
            within_reach = np.less_equal(own, 0, out=told[: own.size].reshape(own.shape))
            rows, cols = np.divmod(np.flatnonzero(within_reach), own.shape[1])
            cols += at
            for i in range(0, len(rows), STRIP // dims):  # where most may be near, some at a time
                r, c = rows[i : i + STRIP // dims], cols[i : i + STRIP // dims]
                d = exact_pairs(q[mine][r], p[c])
                near = d <= limit[r]
                waiting.append((r[near], ids[c[near]], d[near]))
                total += int(near.sum())
            at = tile.stop
            if k is not None and (2 * total >= n * k or at == len(p) or tile.start == 0):
                found = _firsts(*(np.concatenate(x) for x in zip(found, *waiting)), k)
                full = np.flatnonzero(np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) == k - 1)
                limit[found[0][full]] = np.minimum(limit[found[0][full]], found[2][full])
                waiting, total = [], 0
        if waiting:
            found = _firsts(*(np.concatenate(x) for x in zip(found, *waiting)), k)
        out.append((found[0] + start, *found[1:]))
    return tuple(np.concatenate(x) for x in zip(*out))


def tree_order(p: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows of `p` in an order in which every `leaf` of them, from the first on, lie close together: halves by the widest
    dimension, again and again."""
    order, stack = np.arange(len(p)), [(0, len(p))]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            continue
        own = order[a:b]
        x = p[own]
        dim = int(np.argmax(x.max(0) - x.min(0)))
        middle = leaf * (-(-(b - a) // leaf) // 2)
        order[a:b] = own[np.argpartition(x[:, dim], middle)]
        stack += [(a, a + middle), (a + middle, b)]
    return order


def _boxes(p: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(p), leaf)
    return np.minimum.reduceat(p, starts, axis=0), np.maximum.reduceat(p, starts, axis=0)


def _between(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest squared distance that points of each box of `a` and of each box of `b` can have. Every step
    rounds as a distance's does, so no distance of two points lies outside of them, not even by rounding."""
    near, far = (np.zeros((len(a[0]), len(b[0])), a[0].dtype) for _ in range(2))
    for j in range(a[0].shape[1]):
        (la, ha), (lb, hb) = ((x[:, j] for x in box) for box in (a, b))
        gap = np.maximum(np.maximum(lb[None] - ha[:, None], la[:, None] - hb[None]), 0)
        gap *= gap
        near += gap
        reach = np.maximum(hb[None] - la[:, None], ha[:, None] - lb[None])
        reach *= reach
        far += reach
    return near, far


def indexed_within(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int | None, bound: np.ndarray | None, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `within`, by an index of the block: its points in leaves that lie close together, the queries in groups that do.

    A group's k-th distance is no more than the distance within which the leaves that are wholly that near hold k points,
    and no more than what it is among those leaves alone; only leaves that can be nearer than that, and than the group's
    largest bound, are compared with it.
    """
    if len(p) < 4 * leaf or not len(q):
        return within(q, p, ids, k, bound)
    at, of = tree_order(p, leaf), tree_order(q, leaf)
    p, ids = p[at], ids[at]
    near, far = _between(_boxes(q[of], leaf), _boxes(p, leaf))
    starts = np.arange(0, len(p), leaf)
    limit, order, enough = np.full(len(near), np.inf), None, None
    if k is not None and len(p) >= k:
        order = np.argsort(far, axis=1)
        held = np.cumsum(np.diff(np.append(starts, len(p)))[order], axis=1)
        enough = np.argmax(held >= k, axis=1)
        limit = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0].astype(float)
    if bound is not None:
        limit = np.minimum(limit, np.maximum.reduceat(bound[of].astype(float), np.arange(0, len(q), leaf)))
    out, each = [], np.arange(leaf)

    def rows_of(leaves: np.ndarray) -> np.ndarray:
        rows = (starts[leaves][:, None] + each).reshape(-1)
        return rows[rows < len(p)]

    for group in range(len(near)):
        own = of[group * leaf : (group + 1) * leaf]
        leaves = np.flatnonzero(near[group] <= limit[group])
        if enough is not None and len(leaves) > 2 * (enough[group] + 1):
            d = square_distances(q[own], p[rows_of(order[group, : enough[group] + 1])])
            leaves = leaves[near[group, leaves] <= np.partition(d, k - 1, axis=1)[:, k - 1].max()]
        if len(leaves):
            rows = rows_of(leaves)
            r, i, d2 = within(q[own], p[rows], ids[rows], k, None if bound is None else bound[own])
            out.append((own[r], i, d2))
    if not out:
        return np.zeros(0, np.int64), ids[:0], np.zeros(0, q.dtype)
    rows, near_ids, d2 = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(rows, kind="stable")
    return rows[order], near_ids[order], d2[order]


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of each row of `q` to the box in the same row, 0 inside."""
    out = np.zeros(len(q), q.dtype)
    for j in range(q.shape[1]):
        over = np.maximum(np.maximum(low[:, j] - q[:, j], q[:, j] - high[:, j]), 0)
        over *= over
        out += over
    return out


def far_corners(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of each row of `q` to the farthest corner of the box in the same row."""
    out = np.zeros(len(q), q.dtype)
    for j in range(q.shape[1]):
        over = np.maximum(high[:, j] - q[:, j], q[:, j] - low[:, j])
        over *= over
        out += over
    return out


def first_to_hold(rows: np.ndarray, far: np.ndarray, held: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of `n` rows the least of its `far` up to which its entries hold `k`; infinite where all of them hold fewer."""
    order = np.lexsort((far, rows))
    rows, far, held = rows[order], far[order], held[order]
    total = np.cumsum(held)
    first = np.searchsorted(rows, np.arange(n))
    before = np.append(0, total)[first]
    enough = np.flatnonzero(total - before[rows] >= k)
    out = np.full(n, np.inf)
    if len(enough):
        own, place = np.unique(rows[enough], return_index=True)
        out[own] = far[enough[place]]
    return out


def counted_bounds(q: np.ndarray, k: int, nodes: tuple[np.ndarray, ...], counts: np.ndarray) -> np.ndarray:
    """A squared distance of each row of `q` within which `k` points lie for sure, by the boxes of `nodes` and how many points
    each of them holds; infinite where there are not so many.

    First, down the tree into the nearer child while it holds `k`: the far corner of the last box that does. Then, of
    the cells within that, the nearest by their far corners that hold `k` together.
    """
    cell, left, right, low, high = nodes
    bound, rows, at = np.full(len(q), np.inf), np.arange(len(q)), np.zeros(len(q), np.int64)
    while len(rows):
        enough = counts[at] >= k
        rows, at = rows[enough], at[enough]
        bound[rows] = np.minimum(bound[rows], far_corners(q[rows], low[at], high[at]))
        inner = cell[at] < 0
        rows, at = rows[inner], at[inner]
        gaps = [box_distances(q[rows], low[side[at]], high[side[at]]) for side in (left, right)]
        at = np.where(gaps[1] < gaps[0], right[at], left[at])
    node_of = np.zeros(int(cell.max()) + 1, np.int64)
    node_of[cell[cell >= 0]] = np.flatnonzero(cell >= 0)
    finite = np.flatnonzero(np.isfinite(bound))
    if len(finite):
        found = [(i, node_of[c]) for i, c in boxes_within(q[finite], bound[finite], nodes)]
        i, own = (np.concatenate(x) for x in zip(*found))
        tighter = first_to_hold(i, far_corners(q[finite[i]], low[own], high[own]), counts[own], k, len(finite))
        bound[finite] = np.minimum(bound[finite], tighter)
    return bound


def boxes_within(q: np.ndarray, bound: np.ndarray, nodes: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of q, cell) of the cells whose boxes lie within `bound` of a query, at it included; some at a time.

    `nodes` (cell or -1, left, right, low, high) is a tree whose boxes hold those below them, so a subtree that is too
    far is left at once. All queries go down together, FRONTIER pairs of query and node at a time.
    """
    cell, left, right, low, high = nodes
    stack = [(np.arange(len(q)), np.zeros(len(q), np.int64))]
    while stack:
        rows, at = stack.pop()
        if len(rows) > FRONTIER:
            half = len(rows) // 2
            stack += [(rows[:half], at[:half]), (rows[half:], at[half:])]
            continue
        near = box_distances(q[rows], low[at], high[at]) <= bound[rows]
        rows, at = rows[near], at[near]
        leaf = cell[at] >= 0
        if leaf.any():
            yield rows[leaf], cell[at[leaf]]
        rows, at = rows[~leaf], at[~leaf]
        if len(rows):
            stack.append((np.concatenate([rows, rows]), np.concatenate([left[at], right[at]])))
