"""Classification trees on binned rows, in numpy: what the tasks of the forest run.

A row is its bins (the number of a feature's thresholds below the value), a class, a weight
and the number of times a tree's bag holds it. Nodes carry their path number (root 1, children
2p and 2p + 1); a bag is drawn by (seed, tree, block of rows) and the features of a node by
(seed, tree, path), so a tree is the same wherever its parts grow.
"""
from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

#: Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells (node, class, bin) looked at together.
CELLS = 1 << 20
#: Points kept of a column's distribution by one task.
POINTS = 4096
#: Leaf shares are added up as integers: the sum over the trees does not depend on their order.
UNIT = float(1 << 40)


@dataclass(frozen=True)
class Spec:
    """What the trees of a forest have in common."""
    n_trees: int
    n_features: int
    n_classes: int
    n_bins: int
    draw: int                 # features looked at in a node
    max_depth: int
    min_rows: int
    min_share: float
    min_gain: float
    impurity: str
    rate: float               # mean of the bag counts, or share kept without replacement
    replace: bool
    seed: int


# -- draws -------------------------------------------------------------------
def bag(spec: Spec, tree: int, block: int, n: int) -> np.ndarray:
    """How often the tree's bag holds each row of a block."""
    if spec.rate == 1.0 and not spec.replace:
        return np.ones(n, np.uint8)
    key = [spec.seed % (1 << 64), tree]
    rng = np.random.Generator(np.random.Philox(key=key, counter=[0, 0, 0, block]))
    return (rng.poisson(spec.rate, n) if spec.replace else rng.random(n) < spec.rate).astype(np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(spec: Spec, tree: int, paths: np.ndarray) -> np.ndarray:
    """The features that each node looks at: one row per node. Some of them stand in random order, as the first
    of equal splits wins."""
    every, step = np.arange(spec.n_features), np.array([0x9E3779B97F4A7C15], np.uint64)
    if spec.draw >= spec.n_features:
        return np.broadcast_to(every, (len(paths), spec.n_features))
    base = _mix(np.array([spec.seed % (1 << 64)], np.uint64) + step)
    base = _mix(base + np.array([tree + 1], np.uint64) * step)
    at = _mix(base + paths.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    h = _mix(at[:, None] + (every + 1).astype(np.uint64) * step)
    some = np.argpartition(h, spec.draw - 1, axis=1)[:, :spec.draw]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(h, some, axis=1), axis=1), axis=1)


# -- thresholds --------------------------------------------------------------
def condensed(values: np.ndarray, weights: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; of many, `points` at even steps of weight, each with the
    weight since the one before, so that the weight up to a kept value stays exact."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    last = np.flatnonzero(np.append(values[1:] != values[:-1], True))
    upto = np.cumsum(weights)[last]
    values = values[last]
    if len(values) > points:
        step = np.minimum((upto / upto[-1] * points).astype(np.int64), points - 1)
        last = np.flatnonzero(np.append(step[1:] != step[:-1], True))
        values, upto = values[last], upto[last]
    return values, np.diff(upto, prepend=0.0)


def thresholds(values: np.ndarray, weights: np.ndarray, n_bins: int) -> np.ndarray:
    """At most ``n_bins - 1`` thresholds between distinct values: all of them, or those nearest to even
    steps of weight."""
    values, weights = condensed(values, weights, points=sys.maxsize)
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) < n_bins:
        return middle
    upto, step, out = np.cumsum(weights), weights.sum() / n_bins, []
    target = step
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += step
    return np.array(out[:n_bins - 1])


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of the rows of a matrix; a missing value lies above every threshold."""
    small = max((len(c) for c in cuts), default=0) < 256
    out = np.empty(x.shape, np.uint8 if small else np.uint16)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, x[:, f], side="left")
    return out


# -- splits ------------------------------------------------------------------
def _impurity(parts: list[np.ndarray], total: np.ndarray, kind: str) -> np.ndarray:
    if kind == "gini":
        return 1.0 - sum((p / total) ** 2 for p in parts)
    out = np.zeros_like(total)
    for p in parts:
        share = p / total
        out -= share * np.log2(np.where(share > 0, share, 1.0))
    return out


def best_splits(spec: Spec, feats: np.ndarray, sums: list[np.ndarray], counts: list[np.ndarray],
                least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and bin of each node's best split. ``feats`` has a row per node; ``sums[j]`` is
    (class, node, bin) and ``counts[j]`` (node, bin) of the j-th feature of each node. Of equal gains the
    first feature and the first bin win; a gain of 0 means that there is no split."""
    n, nb, k = len(feats), spec.n_bins, spec.n_classes
    gain, feat, at = np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for j in range(feats.shape[1]):
        cell = np.flatnonzero(counts[j])
        node = cell // nb
        left_n = np.cumsum(counts[j].reshape(n, nb), axis=1)
        all_n = left_n[:, -1][node]
        left_n = left_n.reshape(-1)[cell]
        cum = np.cumsum(sums[j].reshape(k, n, nb), axis=2)
        total = [cum[c, :, -1][node] for c in range(k)]
        left = [cum[c].reshape(-1)[cell] for c in range(k)]
        right = [np.maximum(t - x, 0.0) for t, x in zip(total, left)]
        ok = (left_n >= spec.min_rows) & (all_n - left_n >= max(spec.min_rows, 1))
        w, lw, rw = sum(total), sum(left), sum(right)
        ok &= (lw > 0) & (rw > 0) & (lw >= least) & (rw >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = (_impurity(total, w, spec.impurity) - lw / w * _impurity(left, lw, spec.impurity)
                 - rw / w * _impurity(right, rw, spec.impurity))
        g = np.where(ok & (g >= spec.min_gain), g, 0.0)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        top = np.maximum.reduceat(g, first)
        size = np.diff(np.append(first, len(node)))
        hit = np.flatnonzero(g == np.repeat(top, size))
        hit = hit[np.append(True, node[hit][1:] != node[hit][:-1])]
        owner = node[hit]
        better = g[hit] > gain[owner]
        owner, hit = owner[better], hit[better]
        gain[owner], feat[owner], at[owner] = g[hit], feats[owner, j], cell[hit] % nb
    return gain, feat, at


def histograms(spec: Spec, n: int, node: np.ndarray, b: np.ndarray, y: np.ndarray, w: np.ndarray,
               c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight per (class, node, bin) and rows per (node, bin)."""
    key = node * spec.n_bins + b
    cells = n * spec.n_bins
    return (np.bincount(y * cells + key, weights=w, minlength=cells * spec.n_classes),
            np.bincount(key, weights=c, minlength=cells))


# -- growing -----------------------------------------------------------------
def grow(spec: Spec, tree: int, path: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray,
         least: float) -> dict:
    """The subtree below the node ``path``, grown from its rows, reduced by `prune`: ``feat``, ``bin``
    and ``left`` per node (the right child follows the left one; ``left`` of a leaf is -1), ``stats``."""
    k, nb = spec.n_classes, spec.n_bins
    depth0 = path.bit_length() - 1
    rows = np.flatnonzero(c)
    y = y.astype(np.int64)
    c = c.astype(np.float64)
    w = w * c
    stats = [np.bincount(y[rows], weights=w[rows], minlength=k)[None, :]]
    feats, cuts, lefts, gains = [], [], [], []
    paths, start, made = np.array([path], np.int64), np.array([0, len(rows)]), 1
    depth = depth0
    while len(paths):
        n, s = len(paths), stats[-1]
        f_best, b_best, g_best = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n)
        sizes = np.diff(start)
        node = np.repeat(np.arange(n), sizes)
        held = np.add.reduceat(c[rows], start[:-1]) if len(rows) else np.zeros(n)
        open_ = ((s > 0).sum(axis=1) > 1) & (held >= 2 * max(spec.min_rows, 1)) & (sizes > 1)
        if depth >= spec.max_depth:
            open_[:] = False
        cand = np.flatnonzero(open_)
        if len(cand) < n:                     # rows of leaves are done
            mine = open_[node]
            rows, node = rows[mine], (np.cumsum(open_) - 1)[node[mine]]
        start = np.append(0, np.cumsum(sizes[cand]))
        many = max(1, CELLS // (nb * k))
        for a in range(0, len(cand), many):
            z = min(a + many, len(cand))
            part = slice(start[a], start[z])
            r, p = rows[part], node[part] - a
            draws = drawn(spec, tree, paths[cand[a:z]])
            got = [histograms(spec, z - a, p, bins[r, draws[p, j]], y[r], w[r], c[r]) for j in range(draws.shape[1])] \
                if z - a < 256 else None
            if got is None:                   # a wide level: one feature at a time
                g_best[cand[a:z]], f_best[cand[a:z]], b_best[cand[a:z]] = _one_by_one(spec, draws, p, bins, r, y, w, c, least)
            else:
                g_best[cand[a:z]], f_best[cand[a:z]], b_best[cand[a:z]] = best_splits(
                    spec, draws, [h for h, _ in got], [m for _, m in got], least)
        split = np.flatnonzero(g_best > 0)
        left = np.full(n, -1, np.int64)
        left[split] = made + 2 * np.arange(len(split))
        f_best[g_best <= 0] = -1
        feats.append(f_best), cuts.append(b_best), lefts.append(left), gains.append(g_best * s.sum(axis=1))
        made += 2 * len(split)
        if not len(split):
            break
        # The rows of each split node, the left child's before the right one's.
        is_split = g_best[cand] > 0
        mine = is_split[node]
        old_sizes = np.diff(start)[is_split]
        rows, node = rows[mine], (np.cumsum(is_split) - 1)[node[mine]]
        go = bins[rows, f_best[split][node]] > b_best[split][node]
        begin = np.append(0, np.cumsum(old_sizes))
        child = 2 * node + go
        n_child = np.bincount(child, minlength=2 * len(split))
        to = np.append(0, np.cumsum(n_child))
        right_before = np.cumsum(go) - go
        right_in = right_before - right_before[begin[:-1]][node]
        place = np.where(go, right_in, np.arange(len(rows)) - begin[:-1][node] - right_in) + to[child]
        moved = np.empty_like(rows)
        moved[place] = rows
        rows, start = moved, to
        child = np.repeat(np.arange(2 * len(split)), n_child)
        stats.append(np.bincount(child * k + y[rows], weights=w[rows], minlength=2 * len(split) * k).reshape(-1, k))
        paths = np.repeat(paths[split] * 2, 2) + np.tile([0, 1], len(split))
        depth += 1
    return prune(spec, feats, cuts, lefts, gains, stats[:len(feats)])


def _one_by_one(spec, draws, p, bins, r, y, w, c, least):
    """`best_splits` holding the histograms of one feature of each node at a time."""
    n = len(draws)
    gain, feat, at = np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for j in range(draws.shape[1]):
        h, m = histograms(spec, n, p, bins[r, draws[p, j]], y[r], w[r], c[r])
        g, f, b = best_splits(spec, draws[:, j:j + 1], [h], [m], least)
        better = g > gain
        gain[better], feat[better], at[better] = g[better], f[better], b[better]
    return gain, feat, at


def prune(spec: Spec, feats, cuts, lefts, gains, stats) -> dict:
    """Levels of nodes as one tree, without splits whose two sides are leaves of the same prediction."""
    first = np.append(0, np.cumsum([len(x) for x in feats]))
    feat, cut, left, gain = (np.concatenate(x) for x in (feats, cuts, lefts, gains))
    stats = np.concatenate(stats)
    says = stats.argmax(axis=1)
    for d in range(len(feats) - 1, -1, -1):
        here = np.arange(first[d], first[d + 1])
        here = here[left[here] >= 0]
        kid = left[here]
        same = here[(left[kid] < 0) & (left[kid + 1] < 0) & (says[kid] == says[kid + 1])]
        left[same], feat[same], gain[same] = -1, -1, 0.0
    keep = np.zeros(len(left), bool)
    keep[0] = True
    deep = 0
    for d in range(len(feats) - 1):
        here = np.arange(first[d], first[d + 1])
        kid = left[here[keep[here] & (left[here] >= 0)]]
        keep[kid], keep[kid + 1] = True, True
        deep = d + 1 if len(kid) else deep
    name = np.cumsum(keep) - 1
    feat, cut, left, gain, stats = feat[keep], cut[keep], left[keep], gain[keep], stats[keep]
    left = np.where(left >= 0, name[left], -1)
    gained = np.bincount(feat[left >= 0], weights=gain[left >= 0], minlength=spec.n_features)
    return {"feat": feat, "bin": cut, "left": left, "stats": stats, "depth": deep, "gained": gained}


def leaf_shares(stats: np.ndarray) -> np.ndarray:
    """Class shares of nodes in `UNIT`s; nodes without weight have none."""
    total = stats.sum(axis=1, keepdims=True)
    return np.round(stats / np.where(total > 0, total, 1.0) * UNIT).astype(np.int64)


# -- what the tasks of a forest run ------------------------------------------
#: Bytes of a block of rows, about.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 16


def matrix(column) -> np.ndarray:
    """A column of number arrays of one length; what is missing is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blocked(batches, max_rows: int, max_bytes: int):
    """Tables of about so many rows or bytes."""
    import pyarrow as pa
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= max_rows or size >= max_bytes:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def summarise(n_features: int):
    """Rows (x, y, w) to one row per feature: the distribution of its values, and what the rows are."""

    def run(batches):
        import pyarrow as pa
        parts = [([], []) for _ in range(n_features)]
        n, classes, bad, total = 0, 0, 0, 0.0
        for table in blocked(batches, 1 << 20, 32 << 20):
            x = np.concatenate([matrix(c) for c in table["x"].chunks])
            y = table["y"].to_numpy().astype(np.float64)
            w = table["w"].to_numpy().astype(np.float64)
            ok = np.isfinite(x).all(axis=1) & (y >= 0) & (y == np.floor(y)) & (y < 1 << 15) & (w >= 0) & np.isfinite(w)
            n, bad = n + len(ok), bad + int((~ok).sum())
            x, y, w = x[ok], y[ok], w[ok]
            if len(y):
                classes, total = max(classes, int(y.max()) + 1), total + float(w.sum())
            for f, (values, weights) in enumerate(parts):
                v, u = condensed(x[:, f], w) if len(y) else (x[:, f], w)
                values.append(v), weights.append(u)
        if not n:
            return
        rows = []
        for f, (values, weights) in enumerate(parts):
            v, u = np.concatenate(values), np.concatenate(weights)
            v, u = condensed(v, u) if len(v) else (v, u)
            rows.append({"feature": f, "v": v.tobytes(), "u": u.tobytes(), "n": n, "classes": classes, "bad": bad, "total": total})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("feature", pa.int32()), ("v", pa.binary()), ("u", pa.binary()), ("n", pa.int64()),
                                                          ("classes", pa.int32()), ("bad", pa.int64()), ("total", pa.float64())]))
    return run


def chosen(max_bins: int):
    """The summaries of one feature to its thresholds."""

    def run(table):
        import pyarrow as pa
        rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["total"], r["v"], r["u"]))
        v, u = (np.concatenate([np.frombuffer(r[c], np.float64) for r in rows]) for c in "vu")
        n = sum(r["n"] for r in rows)
        cuts = thresholds(v, u, max(1, min(max_bins, n))) if len(v) else v
        return pa.Table.from_pylist([{"feature": rows[0]["feature"], "cuts": cuts.tolist(), "n": n, "bad": sum(r["bad"] for r in rows),
                                      "classes": max(r["classes"] for r in rows), "total": float(sum(r["total"] for r in rows))}],
                                    pa.schema([("feature", pa.int32()), ("cuts", pa.list_(pa.float64())), ("n", pa.int64()), ("bad", pa.int64()),
                                               ("classes", pa.int32()), ("total", pa.float64())]))
    return run


def to_blocks(cuts: list[np.ndarray]):
    """Rows (x, y, w) to blocks of binned rows."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for table in blocked(batches, min(BLOCK_ROWS, max(1, BLOCK_BYTES // len(cuts))), 32 << 20):
            bins = np.concatenate([binned(matrix(c), cuts) for c in table["x"].chunks])
            yield pa.RecordBatch.from_pylist([{"block": block, "n": len(bins), "bins": bins.tobytes(),
                                               "y": table["y"].to_numpy().astype(np.uint16).tobytes(),
                                               "w": table["w"].to_numpy().astype(np.float64).tobytes()}],
                                             pa.schema([("block", pa.int64()), ("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("w", pa.binary())]))
            block += 1
    return run


def opened(row: dict, n_features: int):
    """The arrays of a block."""
    n = row["n"]
    bins = np.frombuffer(row["bins"], np.uint8 if len(row["bins"]) == n * n_features else np.uint16).reshape(n, n_features)
    return bins, np.frombuffer(row["y"], np.uint16), np.frombuffer(row["w"], np.float64)


def each_block(batches):
    """Rows of blocks as dicts, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def node_histograms(spec: Spec, nodes: dict[int, list[tuple[int, list]]]):
    """Blocks to the histograms of large nodes, given per tree as (path, conditions): one row per node and task."""

    def run(batches):
        import pyarrow as pa
        sums, part = {}, None
        for row in each_block(batches):
            part = row["block"] if part is None else part
            bins, y, w = opened(row, spec.n_features)
            y = y.astype(np.int64)
            for tree, large in nodes.items():
                c = bag(spec, tree, row["block"], row["n"])
                for path, conditions in large:
                    ok = follows(conditions, bins)
                    r = np.flatnonzero(c if ok is None else ok & (c > 0))
                    zero = np.zeros(len(r), np.int64)
                    out = []
                    for f in drawn(spec, tree, np.array([path]))[0]:
                        b = bins[r, f]
                        h, m = histograms(spec, 1, zero, b, y[r], w[r] * c[r], c[r])
                        out.append(np.concatenate([h, m, np.bincount(b, minlength=spec.n_bins)]))
                    sums[tree, path] = sums.get((tree, path), 0) + np.array(out)
        for (tree, path), h in sums.items():
            yield pa.RecordBatch.from_pylist([{"tree": tree, "path": path, "part": part, "h": h.tobytes()}],
                                             pa.schema([("tree", pa.int32()), ("path", pa.int64()), ("part", pa.int64()), ("h", pa.binary())]))
    return run


def node_split(spec: Spec, least: float):
    """The histograms of one node to its best split: what goes to either side by class, by row and by bag count."""

    def run(table):
        import pyarrow as pa
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        tree, path = rows[0]["tree"], rows[0]["path"]
        k, nb = spec.n_classes, spec.n_bins
        h = sum(np.frombuffer(r["h"], np.float64) for r in rows).reshape(-1, (k + 2) * nb)
        feats = drawn(spec, tree, np.array([path]))
        gain, feat, at = (x[0] for x in best_splits(spec, feats, [x[:k * nb] for x in h], [x[k * nb:(k + 1) * nb] for x in h], least))
        x = h[int(np.flatnonzero(feats[0] == feat)[0]) if gain > 0 else 0].reshape(k + 2, nb)
        left, both = x[:, :at + 1].sum(axis=1), x.sum(axis=1)
        return pa.Table.from_pylist([{"tree": tree, "path": path, "gain": float(gain), "feat": int(feat), "bin": int(at),
                                      "left": left.tolist(), "right": x[:, at + 1:].sum(axis=1).tolist(), "both": both.tolist()}],
                                    pa.schema([("tree", pa.int32()), ("path", pa.int64()), ("gain", pa.float64()), ("feat", pa.int32()), ("bin", pa.int32()),
                                               *((s, pa.list_(pa.float64())) for s in ("left", "right", "both"))]))
    return run


def to_units(spec: Spec, units: list[list[tuple[int, int, list]]]):
    """Blocks to the rows of each unit, a node of one tree."""

    def run(batches):
        import pyarrow as pa
        by_tree = {}
        for u, ((tree, _, conditions),) in enumerate(units):
            by_tree.setdefault(tree, []).append((u, conditions))
        for row in each_block(batches):
            bins, y, w = opened(row, spec.n_features)
            for tree, some in by_tree.items():
                c = bag(spec, tree, row["block"], row["n"])
                for u, conditions in some:
                    ok = follows(conditions, bins)
                    r = np.flatnonzero(c if ok is None else ok & (c > 0))
                    if len(r):
                        yield pa.RecordBatch.from_pylist(
                            [{"unit": u, "block": row["block"], "n": len(r), "bins": bins[r].tobytes(), "y": y[r].tobytes(), "w": w[r].tobytes(),
                              "c": c[r].tobytes()}],
                            pa.schema([("unit", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), *((s, pa.binary()) for s in ("bins", "y", "w", "c"))]))
    return run


def grow_units(spec: Spec, units: list[list[tuple[int, int, list]]], least: float, keep: bool):
    """Blocks in the order of their units to the trees, or subtrees, of each unit."""

    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("tree", pa.int32()), ("path", pa.int64()), ("conditions", pa.list_(pa.int32())), ("nodes", pa.int64()), ("depth", pa.int32()),
                            ("says", pa.int32()), ("stats", pa.list_(pa.float64())), ("gained", pa.list_(pa.float64())),
                            *((s, pa.binary()) for s in ("feat", "bin", "next", "leaf"))])

        def grown(unit, rows):
            arrays = [opened(r, spec.n_features) for r in rows]
            bins, y, w = (np.concatenate(x) for x in zip(*arrays))
            arrays.clear()
            for tree, path, conditions in units[unit]:
                c = np.concatenate([bag(spec, tree, r["block"], r["n"]) if r["c"] is None else np.frombuffer(r["c"], np.uint8) for r in rows])
                t = grow(spec, tree, path, bins, y, w, c, least)
                yield pa.RecordBatch.from_pylist([part_row(tree, path, conditions, t, keep)], schema)

        unit, held = None, []
        for row in each_block(batches):
            if row["unit"] != unit and held:
                yield from grown(unit, held)
                held = []
            unit = row["unit"]
            held.append(row)
        if held:
            yield from grown(unit, held)
    return run


def part_row(tree: int, path: int, conditions: list, t: dict, keep: bool) -> dict:
    """A subtree as a row: leaves have -1 less their number for a next node, their shares stand in that order."""
    end = t["left"] < 0
    nxt = np.where(end, -np.cumsum(end), t["left"])
    row = {"tree": tree, "path": path, "conditions": [v for c in conditions for v in c], "nodes": len(end), "depth": t["depth"],
           "says": int(t["stats"][0].argmax()), "stats": t["stats"][0].tolist(), "gained": t["gained"].tolist()}
    if keep:
        row |= {"feat": t["feat"].astype(np.int16).tobytes(), "bin": t["bin"].astype(np.int16).tobytes(), "next": nxt.astype(np.int32).tobytes(),
                "leaf": leaf_shares(t["stats"][end]).tobytes()}
    return row


# -- scoring -----------------------------------------------------------------
def scorer(names: list[str], cuts: list[np.ndarray], n_classes: int):
    """Rows with their features in the last column `_x` to rows with `rf_prediction` and `rf_probability`. The trees
    are read from the files that Spark gave the executor, one after the other for 64 K rows at a time."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import SparkFiles
        for table in blocked(batches, BLOCK_ROWS, 64 << 20):
            bins = np.concatenate([binned(matrix(c), cuts) for c in table["_x"].chunks])
            shares = np.zeros((len(bins), n_classes), np.int64)
            for name in names:
                with pq.ParquetFile(SparkFiles.get(name)) as file:
                    for batch in file.iter_batches(batch_size=4, columns=["conditions", "feat", "bin", "next", "leaf"]):
                        for part in batch.to_pylist():
                            ok = follows(list(zip(*[iter(part["conditions"])] * 3)), bins)
                            rows = np.arange(len(bins)) if ok is None else np.flatnonzero(ok)
                            nxt = np.frombuffer(part["next"], np.int32)
                            end = leaves(np.frombuffer(part["feat"], np.int16), np.frombuffer(part["bin"], np.int16), nxt, bins, rows)
                            shares[rows] += np.frombuffer(part["leaf"], np.int64).reshape(-1, n_classes)[-1 - nxt[end]]
            total = shares.sum(axis=1)
            out = table.drop_columns(["_x"])
            out = out.append_column("rf_prediction", pa.array(shares.argmax(axis=1).astype(np.int32)))
            out = out.append_column("rf_probability", pa.array(shares[:, 1] / np.where(total > 0, total, 1)))
            yield from out.to_batches(max_chunksize=10_000)
    return run


def follows(path: list[tuple[int, int, int]], bins: np.ndarray) -> np.ndarray | None:
    """The rows that reach a node by its path (feature, bin, side); None: all."""
    ok = None
    for f, b, side in path:
        go = (bins[:, f] > b) == bool(side)
        ok = go if ok is None else ok & go
    return ok


def leaves(feat: np.ndarray, cut: np.ndarray, left: np.ndarray, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The leaf that each of the given rows ends in, as a node number."""
    out = np.zeros(len(rows), np.int64)
    if left[0] < 0:
        return out
    act, cur = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    while len(act):
        cur = left[cur] + (bins[rows[act], feat[cur]] > cut[cur])
        done = left[cur] < 0
        out[act[done]] = cur[done]
        act, cur = act[~done], cur[~done]
    return out
