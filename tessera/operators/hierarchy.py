"""Hierarchical clusterings of one cross-section under L1, as they run inside a task: the
reachability order with xi extraction, and average linkage by nearest-neighbour chains.  Neither holds
the matrix of all distances but ``average_linkage``, for small cross-sections."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np

from tessera.operators.neighbours import l1_matrix

#: Distances of core distances, and of sums of distances kept by average linkage, at a time.
HELD = 1 << 21

class Rows:
    """Distances of one row to all rows under L1, computed when asked for: memory is that of the rows."""

    def __init__(self, x: np.ndarray):
        self.across = np.ascontiguousarray(x.T)
        self.one, self.n = np.empty(len(x)), len(x)

    def __getitem__(self, p: int) -> np.ndarray:
        out = np.zeros(self.n)
        for column in self.across:
            np.subtract(column[p], column, out=self.one)
            np.abs(self.one, out=self.one)
            out += self.one
        return out


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each row to its k-th nearest row, itself included; a few rows' distances at a time."""
    step = max(1, HELD // max(len(x), 1))
    parts = [np.partition(l1_matrix(x[at : at + step], x), k - 1, axis=1)[:, k - 1].copy() for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def reachability_order(x: np.ndarray, k: int, max_eps: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, reachability in that order, predecessor in that order, -1 for none) of rows under L1.  A row's
    core distance is that to its k-th nearest row, itself included; beyond ``max_eps`` it has none.  A row's
    distances are computed when its turn comes, so there is no matrix."""
    n, dist = len(x), Rows(x)
    core = core_distances(x, k) if n >= k else np.full(n, np.inf)
    core = np.where(core <= max_eps, core, np.inf)
    reach, before, left, order = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool), []
    for _ in range(n):
        p = int(np.flatnonzero(left)[reach[left].argmin()])
        left[p] = False
        order.append(p)
        if np.isfinite(core[p]):
            near = dist[p]
            there = np.where(left & (near <= max_eps), np.maximum(core[p], near), np.inf)
            better = there < reach
            reach[better], before[better] = there[better], p
    order = np.array(order, int)
    return order, reach[order], before[order]


def _steep_areas(r: np.ndarray, xi: float, min_points: int) -> list[tuple[bool, int, int]]:
    """(is it downward, first, last) of the maximal steep areas in order of their first point: they
    begin and end at steep points, never turn, and hold no more than ``min_points`` points in a
    row that are not steep."""
    now, following = r[:-1], r[1:]
    with np.errstate(invalid="ignore"):
        steep = {True: now * (1 - xi) >= following, False: now <= following * (1 - xi)}
    flat = np.isinf(now) & np.isinf(following)
    turns = {True: now < following, False: now > following}
    found = []
    for down in (True, False):
        at, n, is_steep = 0, len(now), steep[down] & ~flat
        while at < n:
            if not is_steep[at]:
                at += 1
                continue
            first = last = at
            idle = 0
            for i in range(at + 1, n):
                if is_steep[i]:
                    last, idle = i, 0
                elif turns[down][i] or idle == min_points:
                    break
                else:
                    idle += 1
            found.append((down, first, last))
            at = last + 1
    return sorted(found, key=lambda x: x[1])


def _cluster_ends(r: np.ndarray, down: tuple[int, int], up: tuple[int, int], xi: float) -> tuple[int, int]:
    """First and last point of the cluster of a downward and an upward area: where one side is
    higher by xi, it is cut at the other side's height."""
    begin, end = r[down[0]], r[up[1] + 1]
    first, last = down[0], up[1]
    if begin * (1 - xi) >= end:
        higher = [x for x in range(down[0], down[1] + 1) if r[x] > end]
        first = higher[-1] if higher else first
    elif end * (1 - xi) >= begin:
        lower = [x for x in range(up[0], up[1] + 1) if r[x] < begin]
        # The area's last point that is still below; what follows has climbed out.
        last = lower[-1] if lower else last
    return first, last


def _corrected(r: np.ndarray, order: np.ndarray, before: np.ndarray, first: int, last: int) -> tuple[int, int] | None:
    """Drops points at the end that were reached from outside the cluster."""
    while first < last:
        if r[first] > r[last] or before[last] in order[first:last]:
            return first, last
        last -= 1
    return None


def xi_clusters(order: np.ndarray, reach: np.ndarray, before: np.ndarray, min_points: int, xi: float = 0.05, least: int | None = None) -> list[tuple[int, int]]:
    """(first, last) in the order of every cluster of ``least`` points or more, inner ones before those
    around them.

    A steep downward and a later steep upward area bound a cluster if the highest point between them
    is lower by xi than both the first area's first point and the point after the second area.
    """
    least = min_points if least is None else least
    r = np.append(reach, np.inf)
    clusters, open_, at, highest = [], [], 0, 0.0
    for down, first, last in _steep_areas(r, xi, min_points):
        if first < at:
            continue
        highest = max(highest, float(r[at : first + 1].max()))
        # An area that something higher than its own beginning has followed bounds nothing any more.
        open_ = [[d, max(top, highest)] for d, top in open_ if highest <= r[d[0]] * (1 - xi)]
        if down:
            open_.append([(first, last), 0.0])
        else:
            for d, top in open_:
                if top > r[last + 1] * (1 - xi):
                    continue
                ends = _cluster_ends(r, d, (first, last), xi)
                ends = _corrected(r, order, before, *ends)
                if ends and ends[1] - ends[0] + 1 >= least and ends[0] <= d[1] and ends[1] >= first:
                    clusters.append(ends)
        at, highest = last + 1, float(r[last + 1])
    return sorted(set(clusters), key=lambda c: (c[1] - c[0], c))


def leaf_labels(order: np.ndarray, clusters: list[tuple[int, int]]) -> np.ndarray:
    """Label of each row, -1 for none: innermost clusters, numbered in the order."""
    kept = []
    for first, last in clusters:
        if all(last < a or first > b for a, b in kept):
            kept.append((first, last))
    out = np.full(len(order), -1, np.int32)
    for number, (first, last) in enumerate(sorted(kept)):
        out[order[first : last + 1]] = number
    return out


def average_linkage(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) by average linkage, each naming the smallest members of what it joins, by rising height.

    A chain goes from cluster to nearest cluster until two are each other's nearest; they merge, and
    the chain goes on from what is left of it.  Average linkage never brings a third one
    nearer, so the merges are those of the closest-pair rule, in n squared steps.  Of equally near
    clusters the one before in the chain comes first, then the one of the smallest member.
    """
    d = dist.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        height = float(d[a, b])
        a, b = min(a, b), max(a, b)
        merged = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[a, a], d[b], d[:, b] = np.inf, np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
        merges.append((a, b, height))
    return sorted(merges, key=lambda m: m[2])


def average_clusters(x: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster of each row by average linkage under L1 after all merges below ``threshold``, numbered by the
    smallest row: ``cut_tree`` of ``average_linkage`` without the matrix.

    A cluster is known by the sums of its members' distances to each row, HELD of them at a time; those of
    two that merge are added, those that went are computed again.  A cluster whose nearest one is not
    below the threshold is done, since no merge brings another nearer, and its rows leave.
    """
    n, dist = len(x), Rows(x)
    label, size = np.arange(n), np.ones(n, np.int64)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    sums: OrderedDict[int, np.ndarray] = OrderedDict()
    alive, chain, start = np.ones(n, bool), [], 0
    most = max(4, HELD * 8 // max(n, 1))

    def held(a: int) -> np.ndarray:
        if a not in sums:
            total = dist[members[a][0]]
            for m in members[a][1:]:
                total = total + dist[m]
            sums[a] = total
            if len(sums) > most:
                sums.popitem(last=False)
        sums.move_to_end(a)
        return sums[a]

    def near(a: int) -> np.ndarray:
        """Average distances to the other clusters at their smallest members."""
        out = np.bincount(label, held(a), n)
        np.divide(out, size * size[a], out=out, where=size > 0)
        out[~alive] = np.inf
        out[a] = np.inf
        return out

    while True:
        if not chain:
            while start < n and not alive[start]:
                start += 1
            if start == n:
                break
            chain = [start]
        a = chain[-1]
        row = near(a)
        b = int(row.argmin())
        if not row[b] < threshold:
            # Only the first of a chain can be without a partner; what leaves keeps its label.
            chain.pop()
            alive[a] = False
            sums.pop(a, None)
            continue
        # Of equally near ones that before comes first; a chain that would come back to itself has met ties.
        if len(chain) > 1 and (row[chain[-2]] <= row[b] or b in chain):
            b = chain[-2]
        else:
            chain.append(b)
            continue
        del chain[-2:]
        total = held(a) + held(b)
        a, b = min(a, b), max(a, b)
        label[members[b]] = a
        members[a].extend(members.pop(b))
        size[a], size[b], alive[b] = size[a] + size[b], 0, False
        sums.pop(b, None)
        sums[a] = total
    return np.unique(label, return_inverse=True)[1].astype(np.int32)


def cut_tree(n: int, merges: list[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """Cluster of each row after all merges below ``threshold``, numbered by the smallest row."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, height in merges:
        if height < threshold:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return np.unique([find(x) for x in range(n)], return_inverse=True)[1].astype(np.int32)
