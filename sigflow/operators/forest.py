"""Multi-output regression forests (ML7): one tree predicts every target.

Features are cut at thresholds taken once (all midpoints where a feature has
few values, else quantiles of a bounded sample). A tree's rows carry Poisson(1)
bootstrap weights that depend on the row's id only. Nodes whose rows are too
large for a task are split level by level from distributed histograms: every
task adds up (rows, weight, weighted targets) by bin for the open nodes of all
trees, the sums are added up in two steps, and only the best split of each node
reaches the driver. A node that fits into a task is finished there. Both ways
look at the same thresholds and take the same split: the largest fall of the
squared error summed over targets, then the first feature, then the lowest
threshold. While a forest grows a row is its bin numbers, a byte a feature: the
features themselves are read once, some rows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.session import cut_lineage

MAX_BINS = 256               # thresholds of a feature plus one
BIN_ROWS = 10_000            # rows (by hash of their id) that thresholds are taken from
LOCAL_BYTES = 128 << 20      # rows of a node that one task may hold
HIST_BYTES = 256 << 20       # histograms of one pass in a task
CHUNK_BYTES = 8 << 20        # histogram of one node and some features, as one row
CELLS = 1 << 22              # running sums held at once in a task
MODEL_BYTES = 64 << 20       # trees dealt to the tasks at once in a prediction
SLICE_ROWS = 512             # rows of a batch that are a matrix at once
ALIKE_ROWS = 32              # rows of a node whose features are compared with each other

_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)])))


@dataclass
class Tree:
    """Node arrays: feature (-1: leaf, -2: finished in a task), threshold,
    children and mean targets."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def pack(self) -> list[bytes]:
        kinds = np.int32, np.float64, np.int32, np.int32, np.float64
        return [np.ascontiguousarray(a, k).tobytes() for a, k in zip(
            (self.feature, self.threshold, self.left, self.right, self.value), kinds)]

    @staticmethod
    def unpack(parts, targets: int) -> Tree:
        kinds = np.int32, np.float64, np.int32, np.int32, np.float64
        a = [np.frombuffer(p, k) for p, k in zip(parts, kinds)]
        return Tree(*a[:4], a[4].reshape(-1, targets))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node at which every row of ``x`` ends."""
        at = np.zeros(len(x), np.int64)
        go = np.arange(len(x))
        while True:
            go = go[self.feature[at[go]] >= 0]
            if not len(go):
                return at
            n = at[go]
            low = x[go, self.feature[n]] <= self.threshold[n]
            at[go] = np.where(low, self.left[n], self.right[n])


@dataclass
class Forest:
    """``tops``: trees as far as they were split by histograms; ``subtrees``:
    (tree, node, bytes of arrays) of those finished in tasks."""
    tops: list
    subtrees: DataFrame
    features: int
    targets: int
    importances: np.ndarray


def bootstrap(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of rows (64-bit hashes of their ids) in a tree."""
    with np.errstate(over="ignore"):
        h = row.astype(np.int64).view(np.uint64) ^ (np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = (h ^ (h >> np.uint64(31))).astype(np.float64) / 2.0**64
    return np.searchsorted(_POISSON, u, "right").astype(np.float64)


def cut_points(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Thresholds of a feature: midpoints between neighbouring values, all of
    them or those next to ``max_bins`` quantiles."""
    v, n = np.unique(values, return_counts=True)
    middle = v[:-1] + (v[1:] - v[:-1]) / 2
    if len(middle) >= max_bins:
        share = np.cumsum(n)[:-1] / n.sum()
        middle = middle[np.unique(np.searchsorted(share, np.arange(1, max_bins) / max_bins).clip(0, len(middle) - 1))]
    return middle


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def thresholds(train: DataFrame, x_col: str, row_col: str, max_bins: int) -> tuple[int, dict[int, np.ndarray]]:
    """(number of features, thresholds by feature with two values at least)."""
    sample = (train.select(F.xxhash64(row_col).alias("_h"), F.col(row_col).alias("_r"), F.col(x_col).alias("x"))
              .orderBy("_h", "_r").limit(BIN_ROWS).select("x"))

    def run(batches):
        rows = [_matrix(b.column(0)) for b in batches if b.num_rows]
        if rows:
            x = np.concatenate(rows)
            found = {f: cut_points(x[:, f], max_bins) for f in np.flatnonzero((x != x[0]).any(0))}
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *found], pa.int32()), pa.array([x.shape[1], *map(len, found.values())], pa.int32()),
                 pa.array([b"", *(e.tobytes() for e in found.values())], pa.binary())], ["feature", "n", "edges"])

    rows = sample.mapInArrow(run, "feature int, n int, edges binary").collect()      # at most max_bins numbers a feature
    if not rows:
        raise ValueError("no training rows")
    width = next(r["n"] for r in rows if r["feature"] < 0)
    return width, {r["feature"]: np.frombuffer(r["edges"]) for r in sorted(rows, key=lambda r: r["feature"]) if r["feature"] >= 0}


def binned(x: np.ndarray, edges: dict[int, np.ndarray]) -> np.ndarray:
    """Bin numbers of the features that have thresholds."""
    out = np.empty((len(x), len(edges)), np.uint8)
    for i, (f, e) in enumerate(edges.items()):
        out[:, i] = np.searchsorted(e, x[:, f], "left")
    return out


def in_bins(tree: Tree, edges: dict[int, np.ndarray]) -> Tree:
    """The tree over bin numbers: a value is at most a threshold where its bin
    is at most the threshold's."""
    place = {f: i for i, f in enumerate(edges)}
    inner = [f >= 0 for f in tree.feature]
    feature = [place[f] if on else f for f, on in zip(tree.feature, inner)]
    threshold = [np.searchsorted(edges[f], t) if on else t for f, t, on in zip(tree.feature, tree.threshold, inner)]
    return Tree(np.array(feature), np.array(threshold, np.float64), tree.left, tree.right, tree.value)


# ------------------------------------------------------------------ a node within a task
def _different(order, bins, of):
    """The places in ``order`` of features that may split its rows: those of two
    bins at least, of several that order and cut the rows alike the first. The
    others never win, in these rows or fewer."""
    keep = np.flatnonzero(bins[of, order[:, 0]] != bins[of, order[:, -1]])
    if order.shape[1] < ALIKE_ROWS:
        return keep
    first = {}
    for i in keep:
        b = bins[of[i]][order[i]]
        first.setdefault((order[i].tobytes(), (b[1:] != b[:-1]).tobytes()), i)
    return np.array(list(first.values()), np.int64)


def _near_best(bits, two, rows, wy, w, min_leaf):
    """(those of ``two`` that can split ``rows`` or fewer, those of them whose
    gain is the highest but for round-off, from a matrix product)."""
    if not len(two):
        return two, two
    sums = np.empty((len(two), wy.shape[1] + 2))
    values = np.column_stack([wy[rows], w[rows], np.ones(len(rows))])
    step = max(1, CELLS // len(rows))
    for a in range(0, len(two), step):
        sums[a:a + step] = bits[two[a:a + step, None], rows] @ values
    whole = values.sum(0)
    good = (sums[:, -1] >= min_leaf) & (whole[-1] - sums[:, -1] >= min_leaf)
    two, high = two[good], sums[good, :-1]
    low = whole[:-1] - high
    gain = (low[:, :-1]**2).sum(1) / low[:, -1] + (high[:, :-1]**2).sum(1) / high[:, -1]
    return two, two[gain >= gain.max(initial=0.0) * (1 - 1e-9)]


def _best(order, bins, of, lead, wy, w, min_leaf):
    """(gain, place in ``order``, bin) of the best split of the rows in ``order``
    (features x rows, sorted by bin), or None. ``bins``: features x all rows;
    ``lead``: the rows in the order in which they are added up as a whole."""
    d, m = order.shape
    total, weight = wy[lead].sum(0), w[lead].sum()
    base = (total * total).sum() / weight
    step = max(1, CELLS // (m * wy.shape[1]))
    by_target = np.ascontiguousarray(wy.T)
    best = None
    lo, hi = min_leaf - 1, m - min_leaf                    # cut after position lo .. hi - 1
    for a in range(0, d, step):
        part = order[a:a + step]
        b = np.take_along_axis(bins[of[a:a + step]], part, 1)
        cut = b[:, lo:hi] != b[:, lo + 1:hi + 1]
        if not cut.any():
            continue
        at = np.nonzero(cut)                               # by feature, then by bin; gains are needed here only
        below = lambda v: np.cumsum(v[part], axis=1)[:, lo:hi][at]  # noqa: B023, E731
        cs, cw = np.stack([below(v) for v in by_target], axis=1), below(w)
        rest = total - cs
        square = lambda v: np.einsum("fmt,fmt->fm", v[None], v[None])[0]
        gain = square(cs) / cw + square(rest) / np.maximum(weight - cw, 1e-300)
        k = int(gain.argmax())
        if best is None or gain[k] > best[0]:
            f, i = at[0][k], at[1][k]
            best = float(gain[k]), a + int(f), int(b[f, lo + i])
    if best is None or best[0] - base <= 1e-12 * max(abs(base), 1e-300):
        return None
    return best[0] - base, best[1], best[2]


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, min_leaf: int,
         edges: dict[int, np.ndarray], width: int) -> tuple[Tree, np.ndarray]:
    """(tree over the real features, fall of squared error by feature) of rows
    with positive weights."""
    names = list(edges)
    feature, threshold, left, right, value = [], [], [], [], []
    gains = np.zeros(width)
    wy = y * w[:, None]

    def node(rows):
        feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1)
        value.append(wy[rows].sum(0) / w[rows].sum())
        return len(feature) - 1

    # features of two bins are bits: no order of their rows is kept
    by_feature = np.ascontiguousarray(bins.T)
    least, most = (v(by_feature, axis=1, initial=i) for v, i in ((np.min, 255), (np.max, 0)))
    two = np.array([m > n and ((c == n) | (c == m)).all() for c, n, m in zip(by_feature, least, most)], bool)
    pairs, of = np.flatnonzero(two), np.flatnonzero(~two & (least < most))
    bits = by_feature[pairs] == most[pairs, None]
    order = np.empty((len(of), len(bins)), np.int32)
    for i, f in enumerate(of):
        order[i] = np.argsort(by_feature[f], kind="stable")
    everything = np.arange(len(bins))
    lead = np.argsort(by_feature[0], kind="stable") if len(by_feature) else everything
    todo = [(node(everything), everything, order, of, np.arange(len(pairs)), lead, depth)]
    inside = np.zeros(len(bins), bool)
    while todo:
        at, rows, order, of, two, lead, levels = todo.pop()
        if levels <= 0 or len(rows) < 2 * min_leaf:
            continue
        if len(of):
            some = _different(order, by_feature, of)
            order, of = order[some], of[some]
        two, near = _near_best(bits, two, rows, wy, w, min_leaf)
        if not len(of) and not len(near):
            continue
        again = [np.concatenate([rows[~bits[k, rows]], rows[bits[k, rows]]]) for k in near]
        every = np.concatenate([of, pairs[near]])
        turn = np.argsort(every)                           # the first feature wins among equals
        every = every[turn]
        found = _best(np.array([*order, *again], np.int32)[turn], by_feature, every, lead, wy, w, min_leaf)
        if found is None:
            continue
        gain, f, b = found
        f = every[f]
        inside[:] = False
        inside[rows[bins[rows, f] <= b]] = True
        low = inside[order]
        m = int(inside[rows].sum())
        feature[at], threshold[at] = names[f], edges[names[f]][b]
        gains[names[f]] += gain
        lows, highs = rows[inside[rows]], rows[~inside[rows]]
        left[at], right[at] = node(lows), node(highs)
        todo.append((right[at], highs, order[~low].reshape(len(order), len(rows) - m), of, two, lead[~inside[lead]], levels - 1))
        todo.append((left[at], lows, order[low].reshape(len(order), m), of, two, lead[inside[lead]], levels - 1))
    return Tree(*map(np.array, (feature, threshold, left, right)), np.array(value)), gains


# ------------------------------------------------------------------ histograms
def _histograms(rows: DataFrame, tops: list, nodes: list[tuple[int, int]], seed: int, edges: dict, bins: int,
                targets: int, min_leaf: int) -> dict:
    """The best split of some (tree, node): gain, feature index, bin, then
    rows, weight and targets below it and in all."""
    from sigflow.operators.ml import _block_sums
    d, stats = len(edges), targets + 2
    chunk = max(1, CHUNK_BYTES // (bins * stats * 8))
    parts = -(-d // chunk)
    slot = {n: i for i, n in enumerate(nodes)}
    trees = {t: in_bins(tops[t], edges) for t in sorted({t for t, _ in nodes})}

    def part(batches):
        from pyspark import TaskContext
        sums = np.zeros((len(nodes), d, bins, stats))
        for batch in batches:
            h, b, y = _unpack(batch, d)
            for t, top in trees.items():
                w = bootstrap(h, t, seed)
                end = top.place(b)
                for node in {n for s, n in nodes if s == t}:
                    on = np.flatnonzero((end == node) & (w > 0))
                    if not len(on):
                        continue
                    out = sums[slot[t, node]].reshape(-1, stats)
                    weights = np.concatenate([np.ones((len(on), 1)), w[on, None], y[on] * w[on, None]], axis=1)
                    for f in range(d):
                        at, into = b[on, f], out[f * bins:(f + 1) * bins]
                        for s in range(stats):
                            into[:, s] += np.bincount(at, weights[:, s], minlength=bins)
        task = TaskContext.get().partitionId()
        for i in range(len(nodes)):
            for p in range(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i * parts + p]), pa.array([task]), pa.array([sums[i, p * chunk:(p + 1) * chunk].tobytes()], pa.binary())],
                    ["block", "task", "sums"])

    def best(pdf):
        out = []
        for block, blob in zip(pdf["block"], pdf["sums"]):
            below = np.cumsum(np.frombuffer(blob).reshape(-1, bins, stats), axis=1)
            whole = below[0, -1]
            rest = whole - below
            good = (below[..., 0] >= min_leaf) & (rest[..., 0] >= min_leaf)
            gain = (below[..., 2:]**2).sum(2) / np.maximum(below[..., 1], 1e-300) + \
                (rest[..., 2:]**2).sum(2) / np.maximum(rest[..., 1], 1e-300) - (whole[2:]**2).sum() / max(whole[1], 1e-300)
            gain = np.where(good, gain, -np.inf)
            f, i = np.unravel_index(int(gain.argmax()), gain.shape)
            out.append((int(block), float(gain[f, i]), int(f) + int(block) % parts * chunk, int(i),
                        below[f, i].tobytes(), whole.tobytes()))
        return pd.DataFrame(out, columns=["block", "gain", "feature", "bin", "below", "whole"])

    sums = _block_sums(rows.mapInArrow(part, "block long, task long, sums binary"), rows.rdd.getNumPartitions())
    found = sums.mapInPandas(lambda it: (best(p) for p in it if len(p)),
                             "block long, gain double, feature int, bin int, below binary, whole binary").collect()
    out: dict = {}
    for r in sorted(found, key=lambda r: r["block"]):
        node = nodes[r["block"] // parts]
        if node not in out or r["gain"] > out[node][0]:
            out[node] = (r["gain"], r["feature"], r["bin"], np.frombuffer(r["below"]), np.frombuffer(r["whole"]))
    return out


def _unpack(batch, d):
    """(row hashes, bins, targets) of a batch of prepared rows."""
    column = lambda n: batch.column(batch.schema.get_field_index(n))
    b = np.frombuffer(b"".join(column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, d)
    return column("h").to_numpy(), b, _matrix(column("y"))


def fit_forest(train: DataFrame, num_trees: int = 200, max_depth: int = 15, min_leaf: int = 5, seed: int = 42,
               x_col: str = "features", y_col: str = "y", row_col: str = "row_id", max_bins: int = MAX_BINS) -> Forest:
    """``num_trees`` trees of at most ``max_depth`` levels, each leaf holding
    at least ``min_leaf`` distinct drawn rows; all features are candidates."""
    if max_bins > 256:
        raise ValueError("bins are bytes: at most 256")
    width, edges = thresholds(train, x_col, row_col, max_bins)
    d, bins = len(edges), max((len(e) for e in edges.values()), default=0) + 1

    def prepare(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(a, SLICE_ROWS)
                column = lambda n: part.column(part.schema.get_field_index(n))  # noqa: B023, E731
                b = binned(_matrix(column("x")), edges)
                yield pa.RecordBatch.from_arrays(
                    [column("h"), pa.array([r.tobytes() for r in b], pa.binary()), column("y")], ["h", "bins", "y"])

    rows = train.select(F.xxhash64(row_col).alias("h"), F.col(x_col).cast("array<double>").alias("x"),
                        F.col(y_col).cast("array<double>").alias("y"))
    rows = cut_lineage(rows.mapInArrow(prepare, "h long, bins binary, y array<double>"))
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("y")).alias("t")).first()
    targets = first["t"]
    most = max(2 * min_leaf, LOCAL_BYTES // (8 * d + 64 * (targets + 4)))    # rows of a node in one task: bins, their copies and orders, targets
    blank = lambda feature: Tree(np.array([feature]), np.zeros(1), np.array([-1]), np.array([-1]), np.zeros((1, targets)))
    tops = [blank(-2 if first["n"] <= most or not d else -1) for _ in range(num_trees)]
    gains = np.zeros((num_trees, width))
    if first["n"] > most and d:
        open_ = [(t, 0) for t in range(num_trees)]
        names, once = list(edges), max(1, HIST_BYTES // (d * bins * (targets + 2) * 8))
        for _ in range(max_depth):
            after = []
            for a in range(0, len(open_), once):
                found = _histograms(rows, tops, open_[a:a + once], seed, edges, bins, targets, min_leaf)
                for (t, node), (gain, f, b, below, whole) in found.items():
                    tree = tops[t]
                    tree.value[node] = whole[2:] / max(whole[1], 1e-300)
                    if not np.isfinite(gain) or gain <= 1e-12 * max((whole[2:]**2).sum() / max(whole[1], 1e-300), 1e-300):
                        continue
                    n = len(tree.feature)
                    tree.feature[node], tree.threshold[node] = names[f], edges[names[f]][b]
                    tree.left[node], tree.right[node] = n, n + 1
                    gains[t, names[f]] += gain
                    sides = below, whole - below
                    tree.feature = np.append(tree.feature, [-1 if s[0] > most else -2 for s in sides])
                    tree.threshold = np.append(tree.threshold, np.zeros(2))
                    tree.left, tree.right = np.append(tree.left, [-1, -1]), np.append(tree.right, [-1, -1])
                    tree.value = np.concatenate([tree.value, [s[2:] / s[1] for s in sides]])
                    after += [(t, n + i) for i, s in enumerate(sides) if s[0] > most]
            open_ = after
            if not open_:
                break

    binned_tops = [in_bins(top, edges) for top in tops]

    def deal(batches):
        for batch in batches:
            h, b, _ = _unpack(batch, d)
            for t, top in enumerate(binned_tops):
                w, end = bootstrap(h, t, seed), top.place(b)
                on = np.flatnonzero((w > 0) & (top.feature[end] == -2))
                take = pa.array(on)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(on), t, np.int32)), pa.array(end[on].astype(np.int32)), pa.array(w[on]),
                     *[batch.column(batch.schema.get_field_index(n)).take(take) for n in ("h", "bins", "y")]],
                    ["tree", "node", "w", "h", "bins", "y"])

    def finish(key, table):
        b = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(table.num_rows, d)
        y = _matrix(table.column("y").combine_chunks())
        order = np.lexsort((*b.T[:1], table.column("h").to_numpy()))       # the same sums whatever the shuffle's order
        top, node = tops[key[0].as_py()], key[1].as_py()
        level, at = 0, node
        while at:                                                          # levels above the node
            at = int(np.flatnonzero((top.left == at) | (top.right == at))[0])
            level += 1
        tree, gain = grow(b[order], y[order], table.column("w").to_numpy()[order], max_depth - level, min_leaf, edges, width)
        names = ["feature", "threshold", "left", "right", "value"]
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([node], pa.int32()),
                         **{n: pa.array([p], pa.binary()) for n, p in zip(names, tree.pack())},
                         "gains": pa.array([gain.tobytes()], pa.binary())})

    dealt = rows.mapInArrow(deal, "tree int, node int, w double, h long, bins binary, y array<double>")
    # much work for few bytes: more tasks than Spark would choose for their size
    dealt = dealt.repartition(16 * train.sparkSession.sparkContext.defaultParallelism, "tree", "node")
    subtrees = cut_lineage(dealt.groupBy("tree", "node").applyInArrow(
        finish, "tree int, node int, feature binary, threshold binary, left binary, right binary, value binary, gains binary"))

    def add(pdf):
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "gains": [sum(np.frombuffer(g) for g in pdf["gains"]).tobytes()]})

    for r in subtrees.select("tree", "gains").groupBy("tree").applyInPandas(add, "tree int, gains binary").collect():
        gains[r["tree"]] += np.frombuffer(r["gains"])                      # one row a tree
    share = gains / np.maximum(gains.sum(1, keepdims=True), 1e-300)
    return Forest(tops, subtrees.drop("gains"), width, targets, share.mean(0))


def predict_forest(df: DataFrame, forest: Forest, x_col: str = "features", out: str = "pred") -> DataFrame:
    """The mean prediction of all trees. Subtrees are dealt to the tasks in
    groups of about ``MODEL_BYTES``, one pass over the rows for each."""
    arrays = ["feature", "threshold", "left", "right", "value"]
    room = sum(F.length(c) for c in arrays)
    total = forest.subtrees.agg(F.sum(room)).first()[0] or 0
    groups = max(1, -(-total // MODEL_BYTES))
    count, targets = len(forest.tops), forest.targets
    result = df.withColumn(out, F.array_repeat(F.lit(0.0), targets))
    for g in range(groups):
        mine = forest.subtrees.where(F.pmod(F.xxhash64("tree", "node"), F.lit(groups)) == g).collect()
        trees = {(r["tree"], r["node"]): Tree.unpack([r[c] for c in arrays], targets) for r in mine}
        tops, first = forest.tops, g == 0

        @F.pandas_udf("array<double>")
        def step(xs: pd.Series, sums: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=object)
            done = []
            for a in range(0, len(xs), SLICE_ROWS):
                x = np.vstack([np.asarray(v, np.float64) for v in xs.iloc[a:a + SLICE_ROWS]])
                total = np.vstack([np.asarray(v, np.float64) for v in sums.iloc[a:a + SLICE_ROWS]])
                for t, top in enumerate(tops):
                    end = top.place(x)
                    kind = top.feature[end]
                    if first and (kind == -1).any():
                        total[kind == -1] += top.value[end[kind == -1]] / count
                    for node in np.unique(end[kind == -2]):
                        tree = trees.get((t, int(node)))
                        if tree is not None:
                            on = np.flatnonzero(end == node)
                            total[on] += tree.value[tree.place(x[on])] / count
                done.extend(total)
            return pd.Series(done)

        result = result.withColumn(out, step(F.col(x_col), F.col(out)))
        if groups > 1:
            result = cut_lineage(result)
    return result
