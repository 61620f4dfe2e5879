"""Trees of a large table, parted exactly until every node is small enough for one group.

``part`` splits each node that holds more rows than a group as ``forest.grow`` would: among the root of the number of
features (more, until one of them can part the rows) the cut of least Gini impurity between any two neighbouring values.
All nodes that are open in any tree are split in the same two scans:

1. Values are dealt to bins: one for each of some values, one between each two. Tasks add up class weights, rows, the
   least and the largest value per (tree, node, feature, bin). That gives all cuts between bins, and for every bin a bound
   that no cut within it can fall below: the impurities of what surely lies left and right of it.
2. Bins that hold several values, and whose bound is not above the best cut so far, are sent to one group per span of
   neighbouring bins, which tries every cut between their values.

The bins come from quantile sketches of the whole table, fine enough that what lies between two of their values fits into
a group; a value that many rows share is a bin of its own and never sent. They decide what is sent, not the cuts.

Scale. Rows stay in place; a scan sends sums, then values of the tried features only. The driver holds the trees down to
the small nodes and the spans of one round. A tree whose cuts take few rows off costs two scans for each of these cuts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CHUNK_BYTES = 32 << 20    # of points that a task looks at together
SUMS_BYTES = 64 << 20     # of sums that a task holds before it hands them on
ROUND_SPANS = 20_000      # that are looked for in one round
SKETCHED = 100            # features in one scan
FOUND = "tree int, node int, feature int, impurity double, threshold double, left array<double>"
SPANS = "first array<int>, last array<int>, bound array<double>, before array<double>"


def reach(tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feature, threshold, below, above = tree[:4]
    at = np.zeros(len(x), np.int64)
    open_rows = np.flatnonzero(feature[at] >= 0)
    while len(open_rows):
        node = at[open_rows]
        low = x[open_rows, feature[node]] <= threshold[node]
        at[open_rows] = np.where(low, below[node], above[node])
        open_rows = open_rows[feature[at[open_rows]] >= 0]
    return at


def unevenness(side: np.ndarray) -> np.ndarray:
    """Gini impurity times weight of rows of class weights."""
    size = side.sum(1)
    return size - (side ** 2).sum(1) / np.maximum(size, 1)


def middle(low: float, high: float) -> float:
    threshold = low + (high - low) / 2
    return threshold if threshold < high else low


def best_cut(x: np.ndarray, counts: np.ndarray, before=0.0, total: np.ndarray | None = None):
    """(impurity, threshold, rows up to the cut, class weights up to it) of the best cut between the values of ``x``.

    ``counts`` are the weighted classes of the rows, ``before`` those of the node's rows with less values, ``total`` those
    of all its rows. None if all values are equal.
    """
    order = np.argsort(x, kind="stable")
    ordered, upto = x[order], np.cumsum(counts[order], axis=0)
    cuts = np.flatnonzero(ordered[1:] > ordered[:-1])
    if not len(cuts):
        return None
    left, total = before + upto[cuts], upto[-1] if total is None else total
    impurity = unevenness(left) + unevenness(total - left)
    best = impurity.argmin()
    at = cuts[best]
    return impurity[best], middle(ordered[at], ordered[at + 1]), at + 1, left[best]


def bin_values(rows: DataFrame, count: int, width: int, group: int) -> list[np.ndarray]:
    """Per feature some of its values, so near to each other that fewer than ``group`` rows lie between two."""
    number = math.ceil(2 * count / group)
    shares = [k / number for k in range(1, number)]
    found = []
    for start in range(0, width, SKETCHED):
        some = rows.agg(*[F.percentile_approx(F.get("x", F.lit(f)), shares, max(1000, 4 * number)).alias(f"f{f}")
                          for f in range(start, min(width, start + SKETCHED))]).first()
        for values in some:
            values = np.unique(np.array(values or [], np.float64))
            found.append(values[~np.isnan(values)])
    return found


def bins_of(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """2 k + 1 for the value k, 2 k for what lies before it."""
    return np.searchsorted(values, x) + np.searchsorted(values, x, "right")


def chunks(batches):
    """Points, labels and draws of many rows together."""
    def joined(held):
        table = pa.Table.from_batches(held)
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return (flat("x").reshape(len(table), -1), table.column("label").to_numpy().astype(np.int64),
                flat("drawn").reshape(len(table), -1))

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(batch.schema.get_field_index("x")).flatten()) * 8
        if size >= CHUNK_BYTES:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def members(x, drawn, tops, asked):
    """(tree, node, features to try, row numbers) of the open nodes."""
    for tree, nodes in asked.items():
        at = np.where(drawn[:, tree] > 0, reach(tops[tree], x), -1)
        for node, columns in nodes.items():
            rows = np.flatnonzero(at == node)
            if len(rows):
                yield tree, node, columns, rows


def listed(values, kind) -> pa.Array:
    offsets = np.cumsum([0, *(v.size for v in values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([v.ravel() for v in values])).cast(kind))


def bin_sums(tops, asked, values, classes: int):
    def handed(held):
        some = [np.flatnonzero(sums[:, -1]) for sums, _, _ in held.values()]
        keys = [pa.array([key[i] for key in held], pa.int32()) for i in range(3)]
        parts = [[part[i][bins] for part, bins in zip(held.values(), some)] for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [*keys, listed(some, pa.int32()), *[listed(p, pa.float64()) for p in parts]],
            names=["tree", "node", "feature", "bin", "sums", "low", "high"])

    def run(batches):
        held, size = {}, 0
        for x, labels, drawn in chunks(batches):
            bins = {}
            for tree, node, columns, rows in members(x, drawn, tops, asked):
                weights, mine = drawn[rows, tree], labels[rows]
                for column in columns:
                    if column not in bins:
                        bins[column] = bins_of(values[column], x[:, column])
                    at, of, count = bins[column][rows], x[rows, column], 2 * len(values[column]) + 1
                    if (tree, node, column) not in held:
                        held[tree, node, column] = (np.zeros((count, classes + 1)), np.full(count, np.nan),
                                                    np.full(count, np.nan))
                        size += count * (classes + 3) * 8
                    sums, low, high = held[tree, node, column]
                    sums[:, :-1] += np.bincount(at * classes + mine, weights, count * classes).reshape(count, classes)
                    sums[:, -1] += np.bincount(at, minlength=count)
                    np.fmin.at(low, at, of)
                    np.fmax.at(high, at, of)
                if size >= SUMS_BYTES:
                    yield handed(held)
                    held, size = {}, 0
        if held:
            yield handed(held)
    return run


def cuts_between(values, classes: int, group: int):
    """The best cut between bins of one feature in one node, and the spans that may hold a better one."""
    def run(key, table):
        tree, node, feature = (k.as_py() for k in key)
        count = 2 * len(values[feature]) + 1
        sums, low, high = np.zeros((count, classes + 1)), np.full(count, np.nan), np.full(count, np.nan)
        for n in range(table.num_rows):
            of = lambda name: table.column(name)[n].values.to_numpy(zero_copy_only=False)
            some = of("bin")
            sums[some] += of("sums").reshape(-1, classes + 1)
            low[some], high[some] = np.fmin(low[some], of("low")), np.fmax(high[some], of("high"))
        some = np.flatnonzero(sums[:, -1])
        sums, low, high = sums[some], low[some], high[some]
        upto = np.cumsum(sums, axis=0)
        before, total = upto - sums, upto[-1]
        best, threshold, left = math.inf, 0.0, np.zeros(classes + 1)
        apart = np.flatnonzero(low[1:] > high[:-1])
        if len(apart):
            impurity = unevenness(upto[apart, :-1]) + unevenness((total - upto[apart])[:, :-1])
            at = apart[impurity.argmin()]
            best, threshold, left = impurity.min(), middle(high[at], low[at + 1]), upto[at]
        bound = unevenness(before[:, :-1]) + unevenness((total - upto)[:, :-1])
        spans = []
        for at in np.flatnonzero((high > low) & (bound <= best * (1 + 1e-9))):
            if spans and upto[at, -1] - before[spans[-1][0], -1] <= group:
                spans[-1] = spans[-1][0], at, min(spans[-1][2], bound[at])
            else:
                spans.append((at, at, bound[at]))
        one = lambda value, kind: pa.array([value], kind)
        return pa.table(
            [one(tree, pa.int32()), one(node, pa.int32()), one(feature, pa.int32()), one(best, pa.float64()),
             one(threshold, pa.float64()), listed([left], pa.float64()),
             listed([some[[s[0] for s in spans]]], pa.int32()), listed([some[[s[1] for s in spans]]], pa.int32()),
             listed([np.array([s[2] for s in spans])], pa.float64()), listed([before[[s[0] for s in spans]]], pa.float64())],
            names=["tree", "node", "feature", "impurity", "threshold", "left", "first", "last", "bound", "before"])
    return run


def span_values(tops, asked, values, spans):
    """Values, labels and draws of the rows in spans; ``spans``: (first bins, last bins, sums before) by tree, node, feature."""
    names = ["tree", "node", "feature", "span", "x", "label", "weight"]

    def run(batches):
        for x, labels, drawn in chunks(batches):
            bins = {}
            for tree, node, columns, rows in members(x, drawn, tops, asked):
                keys, parts = [], []
                for column in columns:
                    if (tree, node, column) not in spans:
                        continue
                    if column not in bins:
                        bins[column] = bins_of(values[column], x[:, column])
                    first, last, _ = spans[tree, node, column]
                    at = bins[column][rows]
                    span = np.searchsorted(first, at, "right") - 1
                    inside = np.flatnonzero((span >= 0) & (at <= last[span]))
                    inside = inside[np.argsort(span[inside], kind="stable")]
                    for mine in np.split(inside, np.flatnonzero(np.diff(span[inside])) + 1):
                        if len(mine):
                            keys.append((tree, node, column, int(span[mine[0]])))
                            parts.append((x[rows[mine], column], labels[rows[mine]], drawn[rows[mine], tree]))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([k[i] for k in keys], pa.int32()) for i in range(4)],
                         *[listed([p[i] for p in parts], kind) for i, kind in enumerate((pa.float64(), pa.int32(), pa.int8()))]],
                        names=names)
    return run


def cuts_within(spans, totals, classes: int):
    def run(key, table):
        tree, node, feature, span = (k.as_py() for k in key)
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x, before, total = flat("x"), spans[tree, node, feature][2][span], totals[tree, node]
        counts = np.zeros((len(x), classes))
        counts[np.arange(len(x)), flat("label")] = flat("weight")
        found = best_cut(x, counts, before[:-1], total[:-1])
        rows = [] if found is None else [{
            "tree": tree, "node": node, "feature": feature, "impurity": found[0], "threshold": found[1],
            "left": [*found[3], before[-1] + found[2]]}]
        return pa.Table.from_pylist(rows, schema=pa.schema([
            ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("impurity", pa.float64()),
            ("threshold", pa.float64()), ("left", pa.list_(pa.float64()))]))
    return run


def best_cuts(rows: DataFrame, tops, asked: dict, totals: dict, values, classes: int, group: int, first_only: set):
    """(feature, threshold, sums on the lower side) by (tree, node), for nodes that one of the asked features parts.

    ``asked``: the features to try by tree and node. Of nodes in ``first_only`` the first feature that parts the rows is taken.
    """
    sums = rows.mapInArrow(bin_sums(tops, asked, values, classes), "tree int, node int, feature int, bin array<int>, "
                           "sums array<double>, low array<double>, high array<double>")
    between = sums.groupBy("tree", "node", "feature").applyInArrow(
        cuts_between(values, classes, group), f"{FOUND}, {SPANS}").collect()
    order = {(tree, node, f): n for tree, nodes in asked.items() for node, columns in nodes.items()
             for n, f in enumerate(columns)}
    best, first = {}, {}

    def better(r):
        at = order[r["tree"], r["node"], r["feature"]]
        rank, key = (r["impurity"], at, r["threshold"]), (r["tree"], r["node"])
        if key in best and best[key][0] <= rank:
            return
        best[key] = rank, (r["feature"], r["threshold"], np.array(r["left"]))

    for r in between:
        if r["impurity"] < math.inf or r["first"]:
            key = r["tree"], r["node"]
            first[key] = min(first.get(key, math.inf), order[(*key, r["feature"])])
    considered = [r for r in between if (r["tree"], r["node"]) not in first_only
                  or first.get((r["tree"], r["node"])) == order[r["tree"], r["node"], r["feature"]]]
    for r in considered:
        if r["impurity"] < math.inf:
            better(r)
    spans = {}
    for r in considered:
        key = r["tree"], r["node"]
        limit = best[key][0][0] * (1 + 1e-9) if key in best else math.inf
        some = np.flatnonzero(np.array(r["bound"]) <= limit)
        if len(some):
            spans[(*key, r["feature"])] = (np.array(r["first"])[some], np.array(r["last"])[some],
                                           np.array(r["before"]).reshape(-1, classes + 1)[some])
    if spans:
        sent = {}
        for tree, node, feature in spans:
            sent.setdefault(tree, {}).setdefault(node, []).append(feature)
        parts = rows.mapInArrow(span_values(tops, sent, values, spans), "tree int, node int, feature int, span int, "
                                "x array<double>, label array<int>, weight array<tinyint>")
        mine = {(tree, node): totals[tree, node] for tree, node, _ in spans}
        for r in parts.groupBy("tree", "node", "feature", "span").applyInArrow(
                cuts_within(spans, mine, classes), FOUND).collect():
            better(r)
    return {key: cut for key, (_, cut) in best.items()}


def features_of(seed: int, tree: int, node: int, width: int) -> list[int]:
    """The features of a large node in the order in which they are tried."""
    return np.random.default_rng([seed, tree, node, 1]).permutation(width).tolist()


def part(rows: DataFrame, count: int, trees: int, width: int, classes: int, seed: int, depth: int | None, group: int):
    """Trees (feature or -1, threshold, child below or equal, child above, level) whose leaves hold at most ``group`` rows
    or cannot be split, and the class weights of the leaves with more rows by (tree, leaf).

    ``rows`` (``count`` of them): ``x``, ``label`` and ``drawn``, how often each tree sees the row.
    """
    grown = [([-1], [0.0], [-1], [-1], [0]) for _ in range(trees)]
    totals = {(tree, 0): np.zeros(classes + 1) for tree in range(trees)}
    drawn = rows.select("label", F.posexplode("drawn").alias("tree", "weight")).where("weight > 0")
    for r in drawn.groupBy("tree", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect():
        totals[r["tree"], 0][[r["label"], -1]] += r["w"], r["n"]

    def large(key) -> bool:
        return totals[key][-1] > group

    def may_split(key) -> bool:
        return (totals[key][:-1] > 0).sum() > 1 and (depth is None or grown[key[0]][4][key[1]] < depth)

    some = max(1, math.isqrt(width))
    work = {key: 0 for key in totals if large(key) and may_split(key)}  # and how many features were tried in vain
    whole = {key: totals[key] for key in totals if large(key) and not may_split(key)}
    values = bin_values(rows, count, width, group) if work else None
    while work:
        asked, size = {}, 0
        for key, tried in work.items():
            if size and size + some * math.ceil(totals[key][-1] / group) > ROUND_SPANS:
                break
            size += some * math.ceil(totals[key][-1] / group)
            asked.setdefault(key[0], {})[key[1]] = features_of(seed, *key, width)[tried:tried + some]
        tops = {tree: frozen(grown[tree]) for tree in asked}
        again = {key for key, tried in work.items() if tried}
        found = best_cuts(rows, tops, asked, totals, values, classes, group, again)
        for tree, nodes in asked.items():
            for node in nodes:
                key, tree_of = (tree, node), grown[tree]
                tried = work.pop(key) + some
                if key not in found:
                    if tried < width:
                        work[key] = tried
                    else:  # equal rows of several classes
                        whole[key] = totals[key]
                    continue
                feature, threshold, left = found[key]
                number = len(tree_of[0])
                tree_of[0][node], tree_of[1][node], tree_of[2][node], tree_of[3][node] = feature, threshold, number, number + 1
                for child, held in ((number, left), (number + 1, totals[key] - left)):
                    for column, value in zip(tree_of, (-1, 0.0, -1, -1, tree_of[4][node] + 1)):
                        column.append(value)
                    totals[tree, child] = held
                    if large((tree, child)) and may_split((tree, child)):
                        work[tree, child] = 0
                    elif large((tree, child)):
                        whole[tree, child] = held
                del totals[key]
    return [frozen(tree) for tree in grown], whole


def frozen(tree):
    feature, threshold, below, above, level = tree
    return (np.array(feature, np.int32), np.array(threshold), np.array(below, np.int32), np.array(above, np.int32),
            np.array(level, np.int32))
