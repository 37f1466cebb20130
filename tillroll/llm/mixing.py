"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the target of
the source over its size.  The expected copies are summed along the source, one
random offset for the source is added, and a document is emitted once for each
integer that its stretch of the sum crosses.  Documents stand in the order of
their size, so what the sample takes is near the target whatever the sizes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.text import merged, written
from tillroll.operators.ranking import global_rank

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for a table of (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times all sizes by weight.  A target stops at ``most`` times the
    source's size; the excess goes to the others by weight until none is above.
    Each round stops one source at least and reads three sums on the driver.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "_k", "_n")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_k") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = written(ranked.select("source", F.col("source_size"), turn.cast("long").alias("w"),
                                 (most * F.col("source_size")).alias("cap")), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # Above this level of target per weight a source is stopped.
        stopped = F.lit(False) if level is None else F.col("cap") <= F.col("w") * F.lit(level)
        held, free = rows.agg(F.coalesce(F.sum(F.when(stopped, F.col("cap"))), F.lit(0.0)),
                              F.coalesce(F.sum(F.when(~stopped, F.col("w"))), F.lit(0))).first()
        if not free:
            break
        new = (share * total - held) / free
        if level is not None and new <= level:
            break
        level = new
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.col("w") * F.lit(float(level)))
    return rows.select("source", "source_size", target.alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the source and the seed alone."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, doc_id: Column, source: Column, size: Column,
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
        seed: int = 11) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``size``, ``source``,
    ``source_size``, ``target`` (of the source), ``copies`` (0 to ``most``) and
    ``taken`` (size times copies).

    A source holding most rows is spread over many tasks: ranks come from a range
    exchange and offsets by partition.  Rows alike in source, size and id are
    interchangeable.  A null size counts as 0; a source of size 0 has target 0 and
    no copies; null is a source of its own, the last; reruns agree.
    """
    rows = written(docs.select(doc_id.alias("doc_id"), source.cast("string").alias("source"),
                               F.coalesce(size, F.lit(0)).cast("long").alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(),
             F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))).asc(), F.col("doc_id").asc()]
    ranked = global_rank(rows, order, "_k", "_n")
    first = ranked.groupBy("source").agg(F.min("_k").alias("_first"))
    of_source = first.join(targets, first["source"].eqNullSafe(targets["source"])).select(
        first["source"].alias("_s"), "_first", "source_size", "target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("_k") - F.col("_first")
    shift = offset_of(F.col("source"), seed)
    crossed = F.floor((place + 1) * each + shift) - F.floor(place * each + shift)
    # Every row has its source; a left join never broadcasts the rows, a merge would bring those of a source together.
    return (ranked.join(of_source, F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("doc_id", "size", "source", "source_size", "target",
                    crossed.cast("long").alias("copies"))
            .withColumn("taken", F.col("size") * F.col("copies")))


def mixed(docs: DataFrame, id_col: str, source_col: str, size: Column, **how) -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``copy`` (1, 2, ...), a row for
    each emission.  An input column called copy is replaced."""
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"),
                        F.col(source_col).cast("string").alias("_source"),
                        F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    key = ["_id", "_source", "_size"]
    taken = written(mix(docs, F.col(id_col), F.col(source_col), size, **how)
                    .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                            F.col("size").alias("_size"), "copies"), "copies")
    turn = F.lit(1)
    if not taken.groupBy(*key).count().where("count > 1").isEmpty():  # repeated rows take turns
        turn = F.row_number().over(Window.partitionBy(*key).orderBy("copies"))
        other = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_row")))
        keyed = keyed.withColumn("_turn", other)
    else:
        keyed = keyed.withColumn("_turn", turn)
    taken = taken.withColumn("_turn", turn).where("copies > 0").select(
        *[F.col(k).alias(f"t{k}") for k in [*key, "_turn"]], "copies")
    same = [keyed[k].eqNullSafe(taken[f"t{k}"]) for k in [*key, "_turn"]]
    emitted = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return keyed.join(merged(taken), same).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c != "copy"], emitted.alias("copy"))
