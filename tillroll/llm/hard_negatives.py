"""Hard negatives with scores by the method of the four Russians.

Vectors are integers.  A candidate is kept as bit planes: bit b of its components,
eight components to a byte.  For an anchor and each group of eight components, a table
of 256 holds the sum of every subset of them; the byte of a plane looks its sum up.
Planes are added from the highest down, doubling in between (the highest counts
negative, two's complement), which gives the full exact inner product.  Tables are made
for a block of anchors at once, so that a lookup brings the sums of the whole block.

Anchors are a stated part of the rows; they are scored against all rows in blocks.
A task gets one block of anchors and one of candidates, whatever the size of a label:
first within each label for the positives, then over all rows for the negatives, whose
bounds are the positives' scores.  Only the few best of each block leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.text import written

#: Rows of a block of candidates and of a block of anchors.
CANDIDATES, ANCHORS = 8192, 256
#: Candidates whose sums are looked up together, so that they stay in the cache.
_STEP = 512


def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """[row, plane, group] bytes of integer ``values`` [row, component]; the components
    are a multiple of eight, the lowest plane comes first."""
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def values_of(packed: np.ndarray) -> np.ndarray:
    """The integers back from their planes."""
    planes = packed.shape[1]
    weight = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    weight[-1] = -weight[-1]
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    return np.einsum("rpd,p->rd", bits, weight)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """[group, byte, anchor]: for each group of eight components, the sums of every subset."""
    n, width = anchors.shape
    table = np.zeros((width // 8, 256, n), kind)
    for g in range(width // 8):
        for j in range(8):
            table[g, 1 << j:2 << j] = table[g, :1 << j] + anchors[:, 8 * g + j].astype(kind)
    return table


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """[candidate, anchor] exact inner products from lookups, doublings and sums."""
    out = np.zeros((len(packed), table.shape[2]), table.dtype)
    for at in range(0, len(packed), _STEP):
        block, acc = packed[at:at + _STEP], out[at:at + _STEP]
        sums = np.empty_like(acc)
        top = block.shape[1] - 1
        for plane in range(top, -1, -1):
            if plane != top:
                acc += acc
            for g in range(len(table)):
                np.take(table[g], block[:, plane, g], axis=0, out=sums, mode="clip")
                if plane == top:
                    np.subtract(acc, sums, out=acc)
                else:
                    acc += sums
    return out


def score_type(planes: int, width: int) -> type:
    """The narrowest integers that hold every score of such vectors, and every sum on the way."""
    bits = 2 * (planes - 1) + max(1, width).bit_length() + 1
    if bits > 62:
        raise ValueError(f"scores of {width} components of {planes} bits need more than 64 bits")
    return np.int32 if bits <= 30 else np.int64


def _integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def _valid(rows: DataFrame, vec_id: Column, vector: Column, label: Column, is_anchor: Column) -> DataFrame:
    """(key, id, label, is_anchor, v): rows with a label and a vector of finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.where(label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("key"), vec_id.cast("long").alias("id"),
        label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        _integers(vector).alias("v"))


def _packed(rows: DataFrame, planes: int, width: int) -> DataFrame:
    """(key, id, label, is_anchor, planes)."""
    def run(batches):
        for b in batches:
            lists = b.column(4)
            size = lists.value_lengths().to_numpy()
            values = np.zeros((b.num_rows, width), np.int64)
            values[np.arange(width)[None, :] < size[:, None]] = lists.flatten().to_numpy()
            packed = bit_planes(values, planes).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([x.tobytes() for x in packed], pa.binary())],
                names=["key", "id", "label", "is_anchor", "planes"])

    return rows.mapInArrow(run, "key long, id long, label long, is_anchor boolean, planes binary")


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


def _scored_blocks(anchors: DataFrame, candidates: DataFrame, within: list[str], blocks: tuple[int, int],
                   planes: int, width: int, pick, schema: str) -> DataFrame:
    """``pick(anchors, candidates, scores)`` for each block of anchors and of candidates
    with equal ``within`` columns; candidates come in the order of ties, by id.  Every row
    is sent once to each block of the other side."""
    keys, kind = [*within, "ab", "cb"], score_type(planes, width)
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # both sides may be one table
    a = own.withColumns({"ab": _block(blocks[0]), "cb": F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1)))})
    c = candidates.withColumns({"cb": _block(blocks[1]), "ab": F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1)))})
    empty = {f.split()[0]: [] for f in schema.split(", ")}

    def planes_of(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t["planes"].to_pylist()), np.uint8).reshape(t.num_rows, planes, width // 8)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = empty
        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right, sort_keys=[("id", "ascending"), ("key", "ascending")],
                                               null_placement="at_end"))
            table = subset_sums(values_of(planes_of(left)), kind)
            columns = pick(left, right, scores(table, planes_of(right)).T) or empty
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, pa.int64()) for k, v in columns.items()})

    return a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(run, schema)


def _first(rows: DataFrame, by: list[str], n: int, score: str, tie: str) -> DataFrame:
    """The ``n`` first rows of each ``by``, ranked from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(tie), "other")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def leading(s: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` greatest values, greatest first; ties in the order of places."""
    near = np.arange(len(s))
    if len(s) > 4 * n:
        near = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n])
    return near[np.argsort(-s[near].astype(np.int64), kind="stable")][:n]


def _positives(packed: DataFrame, count: int, blocks: tuple[int, int], planes: int, width: int) -> DataFrame:
    """(key, positive_id, positive_score, rank): the first ``count`` other rows of the
    anchor's label."""
    def pick(anchors, candidates, s):
        keys, own = candidates["key"].to_numpy(), anchors["key"].to_numpy()
        places = [leading(s[i], count + 1) for i in range(len(own))]
        places = [p[keys[p] != k][:count] for p, k in zip(places, own, strict=True)]
        at, who = np.concatenate(places), np.repeat(np.arange(len(own)), [len(p) for p in places])
        return {"key": own[who], "positive_id": candidates["id"].take(pa.array(at)),
                "positive_score": s[who, at].astype(np.int64), "other": keys[at]}

    rows = packed.select("key", "id", "label", "planes")
    found = _scored_blocks(packed.where("is_anchor").select(rows.columns), rows, ["label"], blocks, planes, width, pick,
                           "key long, positive_id long, positive_score long, other long")
    return _first(found, ["key"], count, "positive_score", "positive_id").drop("other")


def _negatives(anchors: DataFrame, candidates: DataFrame, count: int, band: tuple[int, int],
               blocks: tuple[int, int], planes: int, width: int) -> DataFrame:
    """(key, positive_rank, negative_id, negative_score, rank): the first ``count`` rows of
    another label inside the band of each positive; ``bounds`` are their scores by rank."""
    def pick(anchors, candidates, s):
        labels, keys, picked = candidates["label"].to_numpy(), candidates["key"].to_numpy(), []
        for i, (label, bounds) in enumerate(zip(anchors["label"].to_pylist(), anchors["bounds"].to_pylist(), strict=True)):
            # Whole scores whose hundredfold lies between these multiples of the positive's.
            within = [(-(-band[0] * p // 100), band[1] * p // 100) for p in bounds]
            near = np.flatnonzero((s[i] >= min(x[0] for x in within)) & (s[i] <= max(x[1] for x in within))
                                  & (labels != label))
            falling = -s[i][near].astype(np.int64)
            order = np.argsort(falling, kind="stable")
            near, falling = near[order], falling[order]
            for rank, (low, high) in enumerate(within, 1):
                start = np.searchsorted(falling, -high)
                stop = min(start + count, np.searchsorted(falling, -low, side="right"))
                picked += [(i, rank, x) for x in near[start:stop].tolist()]
        if not picked:
            return None
        who, rank, at = (np.array(x) for x in zip(*picked, strict=True))
        return {"key": anchors["key"].to_numpy()[who], "positive_rank": rank,
                "negative_id": candidates["id"].take(pa.array(at)), "negative_score": s[who, at].astype(np.int64),
                "other": keys[at]}

    found = _scored_blocks(anchors, candidates, [], blocks, planes, width, pick,
                           "key long, positive_rank long, negative_id long, negative_score long, other long")
    return _first(found, ["key", "positive_rank"], count, "negative_score", "negative_id").drop("other")


def hard_negatives(rows: DataFrame, vec_id: Column, vector: Column, label: Column, is_anchor: Column,
                   positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95),
                   candidates_a_block: int = CANDIDATES, anchors_a_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x); a score is the integer inner product.  The positives
    of an anchor are the first ``positives`` other rows of its label, its negatives for
    each positive the first ``negatives`` rows of another label whose score lies within
    ``band`` hundredths of the positive's; higher scores come first, ties by smaller
    ``vec_id``.  Rows with a null label or vector, or a null or non-finite component, take
    no part.  A shorter vector counts as zero beyond its end, an empty one everywhere.  A
    null id comes last in ties; a null ``is_anchor`` is false.  Repeated rows are rows of
    their own.  An empty table, or one without anchors, gives an empty one; extra columns,
    whatever their names, play no part.  Components whose scores need more than 64 bits
    raise an error.
    """
    kept = written(_valid(rows, vec_id, vector, label, is_anchor), "vectors")
    anchors_in = F.count(F.when(F.col("is_anchor"), 1))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    total = kept.agg(F.count("*").alias("n"), anchors_in.alias("anchors"), F.max(F.size("v")).alias("width"),
                     F.max(largest).alias("largest")).first()
    by_label = kept.groupBy("label").agg(F.count("*").alias("n"), anchors_in.alias("anchors")).agg(
        F.max("n").alias("n"), F.max("anchors").alias("anchors")).first()
    planes, width = (total.largest or 0).bit_length() + 1, max(8, -(-(total.width or 0) // 8) * 8)

    def blocks(of) -> tuple[int, int]:
        return max(1, -(-(of.anchors or 0) // anchors_a_block)), max(1, -(-(of.n or 0) // candidates_a_block))

    packed = written(_packed(kept, planes, width), "vectors-packed")
    best = written(_positives(packed, positives, blocks(by_label), planes, width), "positives")
    bounds = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("b")).select(
        "key", F.col("b.positive_score").alias("bounds"))
    asking = packed.where("is_anchor").select("key", "label", "planes").join(bounds, "key")
    found = _negatives(asking, packed.select("key", "id", "label", "planes"), negatives, band, blocks(total), planes, width)
    named = best.withColumnRenamed("rank", "positive_rank").join(
        packed.where("is_anchor").select("key", F.col("id").alias("anchor_id")), "key")
    return named.join(found, ["key", "positive_rank"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score")
