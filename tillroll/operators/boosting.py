"""Second-order boosted trees for all fits at once (ML8, ML11).

A fit is the full training set or one cross-validation fold.  A table of at most
``local_rows`` rows is boosted in one job, a task a fit.  Beyond that all fits boost
in the same jobs, a job a level, with the same functions of the same sums and the same
trees: each task finds its rows' nodes and adds gradients and hessians by (fit, node,
feature, bin); the sums of a node meet in one group, which chooses its split.  These
tables have a size given by the parameters (fits, depth, features, bins), whatever the
rows; the driver gets a row for each node and sends the few new nodes with the next job.
Gradients are whole multiples of 2^-30, so that sums, and with them the trees, do
not depend on how rows are dealt.  Rows are held as blocks of columns with their margins,
which a round brings up to date once.  Margins are written to the shared folder every few
rounds, so that a lost executor costs these rounds at most.

Leaf values and gains carry the L2 penalty of the leaves (lambda 1), each child needs a
hessian of 1, margins start at log odds of 0, as in the usual second-order formulation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.forest import BINS, byte_rows
from tillroll.session import durable_checkpoint

UNIT = 1 << 30
#: Rows of the largest table that is boosted in one job, a task a fit: some 100 bytes each, as
#: many rows as a task grows a forest's subtree from.
LOCAL_ROWS = 1_000_000
#: Rounds between two written tables of margins.
WRITTEN_EVERY = 20
#: Rows of a block.
BLOCK_ROWS = 1 << 16
#: Nodes whose splits a task chooses: every task sends the driver some kilobytes of its own.
TASK_NODES = 16


@dataclass
class BoostParams:
    """Parameters of the reference's estimator: 100 rounds, depth 6, step 0.3, penalty 1."""
    rounds: int = 100
    depth: int = 6
    step: float = 0.3
    penalty: float = 1.0
    least_hessian: float = 1.0
    least_gain: float = 1e-6


@dataclass
class Trees:
    """One tree for each fit, as arrays [fit, node]; the children of node i are 2 i + 1 and
    2 i + 2.  Feature -1 is a leaf, -2 no node."""
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    level: int = field(default=0)

    @classmethod
    def empty(cls, fits: int, depth: int) -> Trees:
        n = (2 << depth) - 1
        feature = np.full((fits, n), -2, np.int16)
        feature[:, 0] = -1
        return cls(feature, np.zeros((fits, n), np.int16), *(np.zeros((fits, n)) for _ in range(3)))

    def nodes_of(self, fit: int, bins: np.ndarray) -> np.ndarray:
        """The node that each row has reached; features lie one after the other in memory."""
        n = len(bins)
        values, rows, here = bins.T.reshape(-1), np.arange(n), np.arange(self.feature.shape[1])
        inner = self.feature[fit] >= 0
        start = np.where(inner, self.feature[fit], 0).astype(np.int64) * n
        # Where a node's rows go: to the left, to the right; from a leaf nowhere.
        to = np.column_stack([np.where(inner, 2 * here + 1 + side, here) for side in (0, 1)]).reshape(-1)
        at = np.zeros(n, np.int64)
        for _ in range(self.level):
            right = values.take(start.take(at) + rows) > self.cut[fit].take(at)
            at = to.take(2 * at + right)
        return at

    def next_of(self, fit: int, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The node below ``at``, or ``at`` itself where that is a leaf."""
        inner = self.feature[fit] >= 0
        moves = np.flatnonzero(inner.take(at))
        node = at.take(moves)
        feature = self.feature[fit].take(node).astype(np.int64)
        right = bins.T.reshape(-1).take(feature * len(bins) + moves) > self.cut[fit].take(node)
        at = at.copy()
        at[moves] = 2 * node + 1 + right
        return at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole multiples of 2^-30."""
    p = sigmoid(margin)
    return np.rint((p - label) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT)


def level_sums(bins: np.ndarray, label: np.ndarray, train: np.ndarray, margin: np.ndarray, tree: Trees,
               nodes: np.ndarray | None = None) -> np.ndarray:
    """[2, fit, node of the level, feature, bin]: sums of gradients and hessians.  ``nodes``
    [fit, row] that the rows have reached are found if not given."""
    fits, width, first = train.shape[1], bins.shape[1], (1 << tree.level) - 1
    count = first + 1
    out = np.zeros((2, fits, count, width, BINS))
    for k in range(fits):
        at = tree.nodes_of(k, bins) if nodes is None else nodes[k]
        rows = np.flatnonzero(train[:, k] & (at >= first) & (tree.feature[k].take(at) == -1))
        if not len(rows):
            continue
        g, h = gradients(margin[:, k].take(rows), label.take(rows))
        base = (at.take(rows) - first) * BINS
        for f in range(width):
            cell = base + bins[:, f].take(rows)
            for i, x in enumerate((g, h)):
                out[i, k, :, f] = np.bincount(cell, x, count * BINS).reshape(count, BINS)
    return out


def best_splits(sums: np.ndarray, p: BoostParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gain, sides) of the best split of each node, from its sums [2, ..., feature,
    bin]: feature * BINS + bin, and [3, 2, ...] gradient and hessian of the node, its left
    and its right child.  Ties go to the earlier feature, then the lower bin."""
    left = np.cumsum(sums / UNIT, -1)
    total = left[..., -1:]
    right = total - left

    def score(x):
        return x[0] ** 2 / (x[1] + p.penalty)

    gain = score(left) + score(right) - score(total)
    gain[(left[1] < p.least_hessian) | (right[1] < p.least_hessian)] = -np.inf
    shape = gain.shape[:-2]
    flat = gain.reshape(*shape, -1)
    best = flat.argmax(-1)

    def at_best(x):
        return np.take_along_axis(x.reshape(*x.shape[:-2], -1), np.broadcast_to(best, x.shape[:-2])[..., None], -1)[..., 0]

    return best, at_best(gain), np.stack([total[..., 0, 0], at_best(left), at_best(right)])


def split_level(tree: Trees, found: tuple[np.ndarray, np.ndarray, np.ndarray], p: BoostParams) -> bool:
    """Enter the best splits [fit, node] of the tree's level and the values of its new leaves;
    false if nothing is left to split."""
    best, gain, (total, *sides) = found
    first = (1 << tree.level) - 1
    here = slice(first, first + best.shape[1])
    alive = tree.feature[:, here] == -1
    g, h = total
    tree.value[:, here] = np.where(alive, -p.step * g / (h + p.penalty), 0.0)
    tree.cover[:, here] = np.where(alive, h, 0.0)
    splits = alive & (gain > p.least_gain) & (tree.level < p.depth)
    tree.feature[:, here][splits] = (best // BINS)[splits]
    tree.cut[:, here][splits] = (best % BINS)[splits]
    tree.gain[:, here][splits] = gain[splits]
    for k, node in zip(*np.nonzero(splits), strict=True):
        for child, side in zip((2 * (first + node) + 1, 2 * (first + node) + 2), sides, strict=True):
            tree.feature[k, child] = -1
            tree.value[k, child] = -p.step * side[0, k, node] / (side[1, k, node] + p.penalty)
            tree.cover[k, child] = side[1, k, node]
    tree.level += 1
    return bool(splits.any()) and tree.level < p.depth


def raised(margin: np.ndarray, bins: np.ndarray, trees: list[Trees]) -> np.ndarray:
    """Margins [row, fit] after further trees."""
    margin = margin.copy()
    for t in trees:
        for k in range(margin.shape[1]):
            margin[:, k] += t.value[k][t.nodes_of(k, bins)]
    return margin


BLOCKS = "id binary, label binary, bins binary, train binary, margin binary"


def _blocks(rows: DataFrame, fits: int) -> DataFrame:
    """``rows`` as blocks of at most ``BLOCK_ROWS``: a row of ``BLOCKS`` each, with margins of 0."""
    def packed(t: pa.Table) -> pa.RecordBatch:
        n = t.num_rows
        bins, train = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(n, -1) for c in ("bins", "train"))
        columns = (t["id"].to_numpy().astype(np.int64), t["label"].to_numpy().astype(np.int32), bins.T, train.T,
                   np.zeros((fits, n)))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns],
                                          names=[f.split()[0] for f in BLOCKS.split(", ")])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= BLOCK_ROWS:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    return rows.select("id", "label", "bins", "train").mapInArrow(run, BLOCKS)


def _arrays(b: pa.RecordBatch, i: int, fits: int) -> tuple:
    """label, bins [row, feature], train [row, fit], margin [row, fit] of a block."""
    def column(name, kind):
        return np.frombuffer(b.column(b.schema.get_field_index(name))[i].as_buffer(), kind)

    label = column("label", np.int32)
    bins, train = (column(c, np.uint8).reshape(-1, len(label)).T for c in ("bins", "train"))
    return label, bins, train.astype(bool), column("margin", np.float64).reshape(fits, -1).T


def _level_splits(state: DataFrame, fits: int, width: int, tree: Trees, partitions: int,
                  p: BoostParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_splits`` [fit, node] of the tree's level: each task adds up its blocks, each
    node's sums are added in a group of their own."""
    count = 1 << tree.level
    shape = (fits, count, width, BINS)

    def add(batches):
        total = np.zeros((2, *shape), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                label, bins, train, margin = _arrays(b, i, fits)
                total += level_sums(bins, label, train, margin, tree).astype(np.int64)
        at = np.argwhere(total[1].any((-1, -2)))
        for k in range(fits):
            nodes = at[at[:, 0] == k, 1]
            g, h = (pa.array([total[x, k, node].tobytes() for node in nodes], pa.binary()) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), k), pa.int32()), pa.array(nodes, pa.int32()), g, h],
                                             names=["fit", "node", "g", "h"])

    def choose(t: pa.Table) -> pa.Table:
        sums = np.zeros((2, 1, width, BINS), np.int64)
        for i, c in enumerate(("g", "h")):
            for x in t[c]:
                sums[i, 0] += np.frombuffer(x.as_buffer(), np.int64).reshape(width, BINS)
        best, gain, sides = best_splits(sums.astype(float), p)
        return pa.table({"fit": t["fit"][:1], "node": t["node"][:1], "best": pa.array(best, pa.int32()), "gain": gain,
                         "sides": pa.array([sides.ravel().tolist()], pa.list_(pa.float64()))})

    sums = state.drop("id").mapInArrow(add, "fit int, node int, g binary, h binary")
    dealt = sums.repartition(min(partitions, -(-fits * count // TASK_NODES)), "fit", "node").groupBy("fit", "node")
    found = dealt.applyInArrow(choose, "fit int, node int, best int, gain double, sides array<double>").collect()
    best, gain = np.zeros((fits, count), np.int64), np.full((fits, count), -np.inf)
    sides = np.zeros((3, 2, fits, count))
    for r in found:
        at = r["fit"], r["node"]
        best[at], gain[at] = r["best"], r["gain"]
        sides[:, :, at[0], at[1]] = np.reshape(r["sides"], (3, 2))
    return best, gain, sides


def _with_margins(state: DataFrame, fits: int, tree: Trees) -> DataFrame:
    def run(batches):
        for b in batches:
            new = []
            for i in range(b.num_rows):
                _, bins, _, margin = _arrays(b, i, fits)
                new.append(raised(margin, bins, [tree]).T.tobytes())
            at = b.schema.get_field_index("margin")
            yield b.set_column(at, "margin", pa.array(new, pa.binary()))

    return state.mapInArrow(run, state.schema)


NODES = "fit int, tree int, node int, feature int, cut int, value double, gain double, cover double"
SCORES = "fit int, id long, label int, score double"


def _node_columns(tree: Trees, number: int, k: int, fit: int) -> dict[str, np.ndarray]:
    """The columns of ``NODES`` of fit ``k`` of one round's trees."""
    at = np.flatnonzero(tree.feature[k] >= -1)
    n = len(at)
    return {"fit": np.full(n, fit), "tree": np.full(n, number), "node": at, "feature": tree.feature[k][at],
            "cut": tree.cut[k][at], "value": tree.value[k][at], "gain": tree.gain[k][at], "cover": tree.cover[k][at]}


def _arrow(columns: dict, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.table({c: pa.array(columns[c], kinds[k]) for c, k in (f.split() for f in schema.split(", "))})


def _boost_here(rows: DataFrame, fits: int, params: BoostParams) -> tuple[DataFrame, DataFrame]:
    """All rounds of a fit in one task."""
    both = NODES.split(", ")[2:] + ["id long", "label int", "score double"]
    schema = ", ".join(["fit int", "tree int", *both])

    def run(t: pa.Table) -> pa.Table:
        fit, n = t["fit"][0].as_py(), t.num_rows
        bins = np.asfortranarray(byte_rows(t["bins"]))
        label = t["label"].to_numpy().astype(float)
        train = byte_rows(t["train"])[:, fit:fit + 1].astype(bool)
        margin, nodes = np.zeros((n, 1)), []
        for r in range(params.rounds):
            tree, at, more = Trees.empty(1, params.depth), np.zeros(n, np.int64), True
            while more:
                more = split_level(tree, best_splits(level_sums(bins, label, train, margin, tree, at[None]), params), params)
                at = tree.next_of(0, bins, at)
            margin = margin + tree.value[0].take(at)[:, None]
            nodes.append(_node_columns(tree, r, 0, fit))
        made = {c: np.concatenate([x[c] for x in nodes]) for c in nodes[0]}
        grown = _arrow(made, NODES)
        scored = _arrow({"fit": np.full(n, fit), "id": t["id"].to_numpy(), "label": t["label"].to_numpy(),
                         "score": sigmoid(margin[:, 0])}, SCORES)
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.concat_tables([grown, scored], promote_options="default").select(names)

    each = rows.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(fits - 1))))
    out = durable_checkpoint(each.repartition(fits, "fit").groupBy("fit").applyInArrow(run, schema))
    names = [[f.split()[0] for f in x.split(", ")] for x in (NODES, SCORES)]
    return out.where("tree is not null").select(names[0]), out.where("tree is null").select(names[1])


def _boost_by_levels(rows: DataFrame, fits: int, width: int, partitions: int,
                     params: BoostParams) -> tuple[DataFrame, DataFrame]:
    """A job a level for all fits."""
    state = durable_checkpoint(_blocks(rows, fits)).persist(StorageLevel.MEMORY_AND_DISK)
    nodes: list[pa.Table] = []
    older = None
    for r in range(params.rounds):
        tree, more = Trees.empty(fits, params.depth), True
        while more:
            more = split_level(tree, _level_splits(state, fits, width, tree, partitions, params), params)
            if older is not None:  # the first level's job has raised the margins
                older.unpersist()
                older = None
        nodes += [_arrow(_node_columns(tree, r, k, k), NODES) for k in range(fits)]
        older, state = state, _with_margins(state, fits, tree)
        if (r + 1) % WRITTEN_EVERY == 0 or r + 1 == params.rounds:
            state = durable_checkpoint(state)
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
    every = durable_checkpoint(fit_probability(state, fits))
    state.unpersist()
    if older is not None:
        older.unpersist()
    return rows.sparkSession.createDataFrame(pa.concat_tables(nodes)), every


def boost(rows: DataFrame, fits: int, width: int, partitions: int, params: BoostParams = BoostParams(),
          local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(nodes of every fit's trees, probability of every row by every fit).

    ``rows`` hold id, label, bins (a byte a feature) and train (a byte a fit: 1 where the
    row belongs to it).  By levels, ``partitions`` tasks read them, or one a core if these
    are more."""
    if rows.count() <= local_rows:
        return _boost_here(rows, fits, params)
    partitions = max(partitions, rows.sparkSession.sparkContext.defaultParallelism)
    return _boost_by_levels(rows.repartition(partitions, F.hash("id")), fits, width, partitions, params)


def fit_probability(scored: DataFrame, fits: int) -> DataFrame:
    """(fit, id, label, score): the probability by every fit."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                label, _, _, margin = _arrays(b, i, fits)
                id_ = np.frombuffer(b.column(b.schema.get_field_index("id"))[i].as_buffer(), np.int64)
                for k in range(fits):
                    columns = {"fit": np.full(len(id_), k), "id": id_, "label": label, "score": sigmoid(margin[:, k])}
                    yield from _arrow(columns, SCORES).to_batches(max_chunksize=10_000)

    return scored.mapInArrow(run, SCORES)
