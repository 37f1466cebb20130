"""Random forests of full trees, without a depth ceiling (ML7).

All trees of all fits (the full training set and every cross-validation fold) grow
together.  A row takes part in a tree as often as a Poisson draw from its key says.

Where no fit has more than ``local_rows`` rows, they are dealt as blocks, once for
``TASK_TREES`` trees.  A task draws them itself and grows one subtree after the other: it
holds a fit's rows, and what growing ``SUBTREE_ROWS`` of them takes.  Larger fits grow by
levels: a row carries the number of its node in each tree.  While a node holds more than
``SUBTREE_ROWS`` rows, its split comes from its class sums by feature and bin, added up by
every task over its rows and once more for each node; its rows then move to the children.
The subtree below a smaller node is grown in one task.  All ways choose splits by the same
function of the same sums, so the bounds change nothing but the work's layout.

Rows to be scored ride along with a draw of zero: they reach their leaf in every tree
without weighing in any split, so that no tree is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import delete_path, scratch_path, written

#: Rows of the largest fit whose trees one task grows: some 60 bytes each at ten features.
LOCAL_ROWS = 8_000_000
#: Rows of the largest node whose subtree is grown at once: some 50 bytes each, and as much
#: again a few times over while a level is split.
SUBTREE_ROWS = 1_000_000
#: Whole trees that a group of rows grows, one after the other.
TASK_TREES = 5
#: Rows that a task adds up or packs at once, and nodes whose sums (40 KB at ten features) it holds.
SUM_ROWS, SUM_NODES = 500_000, 2048
#: Most bins of a feature: a bin is one byte.
BINS = 256
#: Leaf probabilities are added as whole multiples of 2^-40, so that a mean does not
#: depend on the order of its terms.
UNIT = 1 << 40
ROWS = "fit int, tree int, node long, id long, label int, weight int, bins binary"
#: Rows of a fit: their ids, labels and whether they train it (bits 0 and 1 of a byte), bins.
BLOCKS = "fit int, id binary, flags binary, bins binary"
GROWN = ("fit int, tree int, node long, feature int, bin int, left long, right long, weight long, "
         "positive long, id long, p long")
_NAMES = [f.split()[0] for f in GROWN.split(", ")]
_ROOT = 1
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each number."""
    x = np.asarray(x).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def children(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the left and right children, from the parent's."""
    n = np.asarray(node).astype(np.int64).view(np.uint64) * np.uint64(2)
    return mixed(n + np.uint64(0x9E37)).view(np.int64), mixed(n + np.uint64(0x79B9)).view(np.int64)


def priority(node: np.ndarray, tree: int, seed: int, width: int) -> np.ndarray:
    """[node, rank]: features in the random order in which a node considers them."""
    salt = mixed(np.array([tree * 1_000_003 + seed]))
    base = mixed(np.asarray(node).astype(np.int64).view(np.uint64) + salt)
    return np.argsort(mixed(base[:, None] + np.arange(1, width + 1, dtype=np.uint64)[None, :]), axis=1, kind="stable")


def _below() -> list[float]:
    """The share of rows that are drawn k times at most, k = 0 to 11."""
    share, below = 0.36787944117144233, [0.0]
    for k in range(12):
        below.append(below[-1] + share)
        share /= k + 1
    return below[1:]


def poisson_draw(key: str, tree: Column, seed: int) -> Column:
    """How often a row is drawn into a tree: Poisson with mean 1, from a hash of its key."""
    u = F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    draw = F.lit(0)
    for below in _below():
        draw = draw + F.when(u >= below, 1).otherwise(0)
    return draw.cast("int")


_XX = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
                              0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _xx_end(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, _XX[1]), (29, _XX[2])):
        h = (h ^ (h >> np.uint64(shift))) * factor
    return h ^ (h >> np.uint64(32))


def hashed_ids(ids: np.ndarray) -> np.ndarray:
    """``F.xxhash64`` of a long column."""
    h = np.array([42 + 8], np.uint64) + _XX[4]
    h = h ^ (_turned(ids.astype(np.int64).view(np.uint64) * _XX[1], 31) * _XX[0])
    return _xx_end(_turned(h, 27) * _XX[0] + _XX[3])


def draws(hashed: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """``poisson_draw`` of ids of which ``hashed_ids`` are given."""
    out, below = np.empty(len(hashed), np.uint8), np.array(_below())
    for at in range(0, len(hashed), SUM_ROWS):
        h = hashed[at:at + SUM_ROWS]
        for x in (tree, seed):
            h = h + (_XX[4] + np.uint64(4)) ^ np.array([x & 0xFFFFFFFF], np.uint64) * _XX[0]
            h = _xx_end(_turned(h, 23) * _XX[1] + _XX[2])
        u = (h & np.uint64((1 << 40) - 1)).astype(float) / (1 << 40)
        out[at:at + SUM_ROWS] = np.searchsorted(below, u, side="right")
    return out


def best_cut(slot: np.ndarray, bin_: np.ndarray, weight: np.ndarray, positive: np.ndarray,
             count: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, bin) by node of the best split by one feature, gain -1 where there is none.
    Cells (node, bin) are sorted and hold sums above zero; rows of a bin up to the split's
    go left, and the lowest bin wins a tie.  The gain grows as Gini impurity falls."""
    gain, cut = np.full(count, -1.0), np.zeros(count, np.int64)
    if not len(slot):
        return gain, cut
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    size = np.diff(np.append(first, len(slot)))

    def left_and_right(x):
        up = np.cumsum(x)
        before = np.concatenate(([0.0], up[first[1:] - 1]))
        total = np.repeat(up[first + size - 1] - before, size)
        left = up - np.repeat(before, size)
        return left, total - left

    (left, right), (left_pos, right_pos) = left_and_right(weight), left_and_right(positive)
    possible = right > 0
    rest = np.where(possible, right, 1.0)
    each = np.where(possible, (left_pos * left_pos + (left - left_pos) ** 2) / left
                    + (right_pos * right_pos + (right - right_pos) ** 2) / rest, -1.0)
    most = np.maximum.reduceat(each, first)
    at = np.where(each == np.repeat(most, size), np.arange(len(each)), len(each))
    nodes = slot[first]
    gain[nodes], cut[nodes] = most, bin_[np.minimum.reduceat(at, first)]
    return gain, cut


def chosen(gain: np.ndarray, cut: np.ndarray, order: np.ndarray, tried: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) of the split of each node, feature -1 where there is none, from the best
    splits [node, feature]: of the features that can split a node, the first ``tried`` in its
    ``order`` are considered; a tie goes to the earlier."""
    each = np.arange(len(gain))
    ranked = np.take_along_axis(gain, order, 1)
    usable = ranked >= 0
    ranked = np.where(usable & (np.cumsum(usable, 1) <= tried), ranked, -1.0)
    place = ranked.argmax(1)
    feature = order[each, place]
    return np.where(ranked[each, place] >= 0, feature, -1), cut[each, feature]


def _cells(key: np.ndarray, weight: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(cell, weight, positive) of the cells below ``size`` that ``key`` names, in order."""
    if size <= 2 * len(key):
        sums = np.bincount(2 * key + label, weight, 2 * size).reshape(-1, 2)
        total = sums.sum(1)
        cell = np.flatnonzero(total)
        return cell, total[cell], sums[cell, 1]
    # More cells than rows: rows in order of their cells, each with its place in the last digits.
    shift = len(key).bit_length()
    key = np.sort(key << shift | np.arange(len(key)))
    key, at = key >> shift, key & (1 << shift) - 1
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    weight = weight[at]
    return key[first], np.add.reduceat(weight, first), np.add.reduceat(weight * label[at], first)


def _local_splits(slot, rows, bins, weight, label, nodes, tree, tried, seed) -> tuple[np.ndarray, ...]:
    """(feature, bin, weight, positive) of each node, from its ``rows`` of ``bins``."""
    count, width = len(nodes), bins.shape[1]
    both = np.bincount(2 * slot + label, weight, 2 * count).reshape(-1, 2)
    total, total_pos = both.sum(1), both[:, 1]
    # Nodes of one class are leaves; the others are numbered anew, so that cells stay few.
    is_mixed = (total_pos > 0) & (total_pos < total)
    mixed_nodes, drawn = np.flatnonzero(is_mixed), np.flatnonzero((weight > 0) & is_mixed.take(slot))
    feature_of, cut_of = np.full(count, -1), np.zeros(count, np.int64)
    if not len(mixed_nodes):
        return feature_of, cut_of, total, total_pos
    slot, weight, label = (np.cumsum(is_mixed) - 1).take(slot.take(drawn)), weight.take(drawn), label.take(drawn)
    first, values = rows.take(drawn) * width, bins.reshape(-1)
    order = priority(nodes[mixed_nodes], tree, seed, width)
    count = len(mixed_nodes)
    gain, cut, usable = np.full((count, width), -1.0), np.zeros((count, width), np.int64), np.zeros(count, np.int64)
    # Each node's features in its order: those after the first ``tried`` that split it do not count.
    for feature in order.T:
        key = slot * BINS + values.take(first + feature.take(slot))
        cell, sums, pos = _cells(key, weight, label, count * BINS)
        each = np.arange(count), feature
        gain[each], cut[each] = best_cut(cell // BINS, cell % BINS, sums, pos, count)
        usable += gain[each] >= 0
        wanting = usable < tried
        if not wanting.any():
            break
        if not wanting.all():
            left = np.flatnonzero(wanting.take(slot))
            slot, first, weight, label = (x.take(left) for x in (slot, first, weight, label))
    feature_of[mixed_nodes], cut_of[mixed_nodes] = chosen(gain, cut, order, tried)
    return feature_of, cut_of, total, total_pos


def grow(root: int, tree: int, ids: np.ndarray, label: np.ndarray, weight: np.ndarray, bins: np.ndarray,
         tried: int, seed: int) -> dict[str, np.ndarray]:
    """The subtree of one node, level by level, and the leaf that each row of weight 0
    reaches: the columns of ``GROWN`` without fit and tree."""
    out = []
    label, weight, values = label.astype(np.int64), weight.astype(float), bins.reshape(-1)
    nodes, slot, rows = np.array([root], np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))
    while len(nodes):
        feature, cut, total, total_pos = _local_splits(slot, rows, bins, weight.take(rows), label.take(rows), nodes,
                                                     tree, tried, seed)
        left, right = children(nodes)
        splits = feature >= 0
        out.append(_level(nodes, feature, cut, left, right, total, total_pos))
        goes = splits.take(slot)
        ends = np.flatnonzero(~goes)
        riders = ends[weight.take(rows.take(ends)) == 0]
        out.append(_reached(ids[rows[riders]], slot[riders], total, total_pos, nodes))
        goes = np.flatnonzero(goes)
        rows, slot = rows.take(goes), slot.take(goes)
        go_right = values.take(rows * bins.shape[1] + feature.take(slot)) > cut.take(slot)
        slot = (2 * (np.cumsum(splits) - 1)).take(slot) + go_right
        nodes = np.column_stack([left[splits], right[splits]]).ravel()
    return {c: np.concatenate([x[c] for x in out]) for c in _NAMES[2:]}


def leaf_share(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Share of the positive class in units of 2^-40; 0 for an empty leaf."""
    return np.floor(positive / np.maximum(weight, 1) * UNIT).astype(np.int64)


def _level(node, feature, cut, left, right, weight, positive) -> dict[str, np.ndarray]:
    inner = feature >= 0
    return {"node": node, "feature": feature, "bin": np.where(inner, cut, -1), "left": np.where(inner, left, 0),
            "right": np.where(inner, right, 0), "weight": weight.astype(np.int64), "positive": positive.astype(np.int64),
            "id": np.full(len(node), -1), "p": leaf_share(weight, positive)}


def _reached(ids, slot, weight, positive, node) -> dict[str, np.ndarray]:
    n = len(ids)
    return {"node": node[slot], "feature": np.full(n, -2), **{c: np.full(n, -1) for c in ("bin", "left", "right",
            "weight", "positive")}, "id": ids, "p": leaf_share(weight, positive)[slot]}


def byte_rows(column: pa.ChunkedArray) -> np.ndarray:
    """[row, byte] of a binary column whose values are equally long."""
    parts = []
    for c in column.cast(pa.binary()).chunks:
        if len(c):
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(c), -1))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _table(columns: dict, fit: int, tree: int) -> pa.Table:
    n = len(columns["node"])
    columns = {"fit": np.full(n, fit), "tree": np.full(n, tree), **columns}
    small = {"fit", "tree", "feature", "bin"}
    return pa.table({c: pa.array(columns[c], pa.int32() if c in small else pa.int64()) for c in _NAMES})


def _finished(rows: DataFrame, tried: int, seed: int, tasks: int) -> DataFrame:
    """Subtrees of whole nodes, one group each."""
    def run(t: pa.Table) -> pa.Table:
        # By id, so that the result does not follow the order of arrival.
        t = t.sort_by("id")
        fit, tree, node = (t[c][0].as_py() for c in ("fit", "tree", "node"))
        return _table(grow(node, tree, *(t[c].to_numpy() for c in ("id", "label", "weight")), byte_rows(t["bins"]),
                           tried, seed), fit, tree)

    keys = ["fit", "tree", "node"]
    return rows.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, GROWN)


def _best_of_node(node: int, tree: int, tried: int, seed: int, width: int, sums) -> tuple[np.ndarray, ...]:
    """(feature, bin, weight, positive) of one node, from ``sums(feature)``: weight and positive
    by bin.  Features after the first ``tried`` that split it are not asked for."""
    part = np.array([node], np.int64)
    order = priority(part, tree, seed, width)
    gain, cut, usable = np.full((1, width), -1.0), np.zeros((1, width), np.int64), 0
    for feature in order[0].tolist():
        weight, positive = sums(feature)
        total, total_pos = weight.sum(keepdims=True), positive.sum(keepdims=True)
        if not 0 < total_pos[0] < total[0]:
            break
        own = np.flatnonzero(weight)
        gain[:, feature], cut[:, feature] = best_cut(np.zeros(len(own), np.int64), own, weight[own], positive[own], 1)
        usable += gain[0, feature] >= 0
        if usable == tried:
            break
    return *chosen(gain, cut, order, tried), total, total_pos


def grow_tree(tree: int, label: np.ndarray, weight: np.ndarray, train: np.ndarray, bins: np.ndarray,
              tried: int, seed: int) -> Iterator[dict[str, np.ndarray]]:
    """A whole tree in parts of at most ``SUBTREE_ROWS`` rows, as ``grow`` returns them; ids are places
    of rows.  Training rows have a weight above zero or take no part."""
    values, width = bins.reshape(-1), bins.shape[1]
    todo = [(_ROOT, np.flatnonzero((weight > 0) | ~train))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= SUBTREE_ROWS:
            if len(rows):
                yield grow(node, tree, rows, label.take(rows), weight.take(rows), bins.take(rows, 0), tried, seed)
            continue

        def sums(feature):
            total = np.zeros(2 * BINS)
            for at in range(0, len(rows), SUM_ROWS):
                part = rows[at:at + SUM_ROWS]
                key = 2 * values.take(part * width + feature).astype(np.int64) + label.take(part)
                total += np.bincount(key, weight.take(part), 2 * BINS)
            return total.reshape(-1, 2).sum(1), total[1::2]

        part = np.array([node], np.int64)
        feature, cut, total, total_pos = _best_of_node(node, tree, tried, seed, width, sums)
        left, right = children(part)
        yield _level(part, feature, cut, left, right, total, total_pos)
        if feature[0] < 0:
            riders = rows[weight.take(rows) == 0]
            yield _reached(riders, np.zeros(len(riders), np.int64), total, total_pos, part)
        else:
            go_right = values.take(rows * width + feature[0]) > cut[0]
            todo += [(int(right[0]), rows[go_right]), (int(left[0]), rows[~go_right])]


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` as ``BLOCKS``."""
    def packed(held):
        t = pa.Table.from_batches(held)
        fit, ids = t["fit"].to_numpy(), t["id"].to_numpy()
        flags, bins = (t["label"].to_numpy() + 2 * t["is_train"].to_numpy()).astype(np.uint8), byte_rows(t["bins"])
        for k in np.unique(fit).tolist():
            at = np.flatnonzero(fit == k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), *(pa.array([x.take(at, 0).tobytes()], pa.binary()) for x in (ids, flags, bins))],
                names=[f.split()[0] for f in BLOCKS.split(", ")])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= SUM_ROWS:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return rows.where("is_train is not null").select(
        F.col("fit").cast("int"), F.col("id").cast("long"), F.col("label").cast("int"), "is_train", "bins").mapInArrow(run, BLOCKS)


def _whole_trees(rows: DataFrame, trees: int, width: int, tried: int, seed: int, tasks: int,
                 node_fits: list[int] | None = None) -> DataFrame:
    """``GROWN`` of fits that one task can hold: a group grows ``TASK_TREES`` trees of a fit from
    one copy of its rows.  The leaf shares of a row are added up over these trees, in the row
    of the first."""
    wanted = None if node_fits is None else set(node_fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, kinds = [[], [], []], (np.int64, np.uint8, np.uint8)
        for b in batches:
            fit, first = b["fit"][0].as_py(), b["tree"][0].as_py()
            for held, c, kind in zip(parts, ("id", "flags", "bins"), kinds, strict=True):
                held += [np.frombuffer(x.as_buffer(), kind) for x in b[c]]
        ids, flags, bins = (np.concatenate(parts.pop(0)) for _ in range(3))
        bins, label, train = bins.reshape(-1, width), flags & 1, flags > 1
        riders, hashed, shares = np.flatnonzero(~train), hashed_ids(ids), np.zeros(len(ids), np.int64)
        for tree in range(first, min(first + TASK_TREES, trees)):
            weight = np.where(train, draws(hashed, tree, seed), np.uint8(0))
            for grown in grow_tree(tree, label, weight, train, bins, tried, seed):
                reached = grown["feature"] == -2
                shares[grown["id"][reached]] += grown["p"][reached]
                if wanted is None or fit in wanted:
                    yield from _table({c: x[~reached] for c, x in grown.items()}, fit, tree).to_batches(SUM_ROWS)
        for at in range(0, len(riders), SUM_ROWS):
            part = riders[at:at + SUM_ROWS]
            n = len(part)
            yield from _table({"node": np.full(n, _ROOT), "feature": np.full(n, -2), **{c: np.full(n, -1) for c in (
                "bin", "left", "right", "weight", "positive")}, "id": ids[part], "p": shares[part]}, fit, first).to_batches()

    dealt = _blocks(rows).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(TASK_TREES))))
    return dealt.repartition(tasks, "fit", "tree").groupBy("fit", "tree").applyInArrow(run, GROWN)


def _class_sums(rows: DataFrame, width: int) -> DataFrame:
    """(fit, tree, node, weight, positive): sums of draws by feature and bin, [feature, bin]
    of 64-bit numbers; a row for each node and task, or a few where it meets many nodes."""
    def run(batches):
        held, found, n = [], {}, 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= SUM_ROWS:
                _add_up(pa.Table.from_batches(held), width, found)
                held, n = [], 0
                if len(found) > SUM_NODES:
                    yield _sums_batch(found)
                    found = {}
        if n:
            _add_up(pa.Table.from_batches(held), width, found)
        if found:
            yield _sums_batch(found)

    drawn = rows.where("weight > 0").select("fit", "tree", "node", "label", "weight", "bins")
    return drawn.mapInArrow(run, "fit int, tree int, node long, weight binary, positive binary")


def _add_up(t: pa.Table, width: int, found: dict) -> None:
    """Add the rows' draws to the sums [2, feature, bin] of their (fit, tree, node)."""
    fit, tree, node, label, weight = (t[c].to_numpy() for c in ("fit", "tree", "node", "label", "weight"))
    bins, trees = byte_rows(t["bins"]), int(tree.max()) + 1
    nodes, place = np.unique(node, return_inverse=True)
    groups = (int(fit.max()) + 1) * trees
    keys, slot = np.unique(place * groups + fit.astype(np.int64) * trees + tree, return_inverse=True)
    sums = np.empty((2, len(keys), width, BINS), np.int64)
    for f in range(width):
        cell = slot * BINS + bins[:, f]
        for i, x in enumerate((weight, weight * label)):
            sums[i, :, f] = np.bincount(cell, x, len(keys) * BINS).reshape(-1, BINS)
    for i, k in enumerate(keys.tolist()):
        key = k % groups // trees, k % trees, int(nodes[k // groups])
        if key in found:
            found[key] += sums[:, i]
        else:
            found[key] = sums[:, i].copy()


def _sums_batch(found: dict) -> pa.RecordBatch:
    keys = zip(*found, strict=True)
    columns = [pa.array(k, kind) for k, kind in zip(keys, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
    columns += [pa.array([x[i].tobytes() for x in found.values()], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["fit", "tree", "node", "weight", "positive"])


def _split_level(rows: DataFrame, large: DataFrame, width: int, tried: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(nodes of this level, rows at the children) of the nodes in ``large``: the rows of a
    node that does not split come back as leaf rows in the first table."""
    def run(t: pa.Table) -> pa.Table:
        fit, tree, node = (t[c][0].as_py() for c in ("fit", "tree", "node"))
        weight, positive = (sum(np.frombuffer(x.as_buffer(), np.int64) for x in t[c]).reshape(width, BINS).astype(float)
                            for c in ("weight", "positive"))
        part = np.array([node], np.int64)
        split, at, total, total_pos = _best_of_node(node, tree, tried, seed, width, lambda f: (weight[f], positive[f]))
        return _table(_level(part, split, at, *children(part), total, total_pos), fit, tree)

    keys = ["fit", "tree", "node"]
    nodes = written(_class_sums(rows.join(large, keys, "left_semi"), width).groupBy(*keys).applyInArrow(run, GROWN))
    moved = rows.join(nodes.select(*keys, "feature", F.col("bin").alias("cut"), "left", "right", "p"), keys)
    value = F.expr("cast(conv(hex(substring(bins, feature + 1, 1)), 16, 10) as int)")
    below = (moved.where("feature >= 0")
             .withColumn("node", F.when(value <= F.col("cut"), F.col("left")).otherwise(F.col("right")))
             .select(rows.columns))
    zero = F.lit(-1).cast("long")
    leaves = moved.where("feature < 0 and weight = 0").select(
        *keys, F.lit(-2).alias("feature"), F.lit(-1).alias("bin"), zero.alias("left"), zero.alias("right"),
        zero.alias("weight"), zero.alias("positive"), "id", "p")
    return nodes.unionByName(leaves), below


def grow_forests(rows: DataFrame, trees: int, width: int, tried: int, seed: int,
                 local_rows: int = LOCAL_ROWS, node_fits: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of the forests of all fits; nodes of ``node_fits`` only, if given.

    ``rows`` hold fit, id, label, bins (a byte a feature) and is_train; ids are unique in a
    fit.  ``nodes``: a row for each node with the class sums of its training draws and its
    children; feature -1 marks a leaf.  ``leaves``: for each row that is not for training, the
    share of the positive class at its leaf, in units of 2^-40, by tree or added up over a few."""
    sizes = rows.groupBy("fit").count().agg(F.max("count").alias("most"), F.sum("count").alias("all"),
                                            F.count("*").alias("fits")).first()
    # Trees are work for the cores, however small: tasks hold a few groups of the largest size.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if (sizes["most"] or 0) <= local_rows:
        # Far more tasks than groups: few tasks get two.
        groups = sizes["fits"] * -(-trees // TASK_TREES)
        tasks = 4 * groups if (sizes["all"] or 0) * trees > SUBTREE_ROWS else 2 * cores
        grown = written(_whole_trees(rows, trees, width, tried, seed, max(1, tasks), node_fits))
    else:
        local_rows = min(local_rows, SUBTREE_ROWS)
        grown = _grown_by_levels(rows, trees, width, tried, seed, local_rows,
                                 max(2 * cores, sizes["all"] * trees // local_rows))
    nodes = grown.where("feature >= -1").drop("id")
    if node_fits is not None:
        nodes = nodes.where(F.col("fit").isin(node_fits))
    return nodes, grown.where("feature = -2").select("fit", "tree", "id", "p")


def _grown_by_levels(rows: DataFrame, trees: int, width: int, tried: int, seed: int, local_rows: int,
                     tasks: int) -> DataFrame:
    """``GROWN`` of fits of any size."""
    tree = F.col("tree")
    weight = F.when(F.col("is_train"), poisson_draw("id", tree, seed)).otherwise(F.lit(0))
    bag = (rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
           .withColumn("weight", weight).where("weight > 0 or not is_train")
           .select("fit", "tree", F.lit(_ROOT).cast("long").alias("node"), F.col("id").cast("long").alias("id"),
                   F.col("label").cast("int").alias("label"), "weight", "bins"))
    out, large, held = [], True, []
    while large:
        held.append(scratch_path(rows.sparkSession))
        bag = written(bag, held[-1])
        for path in held[:-1]:  # read for the last time
            delete_path(rows.sparkSession, path)
        held = held[-1:]
        # A row for each node: every join with it leaves the rows where they are.
        size = written(bag.groupBy("fit", "tree", "node").agg(F.count("*").alias("_n")))
        small, large_nodes = (size.where(c).drop("_n") for c in (F.col("_n") <= local_rows, F.col("_n") > local_rows))
        out.append(written(_finished(bag.join(small, ["fit", "tree", "node"], "left_semi"), tried, seed, tasks)))
        large = not large_nodes.isEmpty()
        if large:
            done, bag = _split_level(bag, large_nodes, width, tried, seed)
            out.append(written(done))
        else:
            delete_path(rows.sparkSession, held.pop())
    grown = out[0]
    for more in out[1:]:
        grown = grown.unionByName(more)
    return grown


def forest_probability(leaves: DataFrame, trees: int) -> DataFrame:
    """(fit, id, score): the mean share over the trees, the same whatever the order."""
    return leaves.groupBy("fit", "id").agg((F.sum("p").cast("double") / float(trees * UNIT)).alias("score"))
