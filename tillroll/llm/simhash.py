"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint of 64 bits has eight positional bytes.  Two fingerprints that
differ in d bits or fewer share 8 - d positional bytes at least: that is the
guaranteed minimum of matches.  The index therefore has a posting list for each
choice of that many positions and their bytes; any pair to be found meets in
one.  In a list the shared positional bytes of each pair are tallied, pairs
below the minimum go, and the bit distance of the others is verified.  Equal
fingerprints are indexed once, and a list yields the links that hold its parts
together, never all its pairs.

Lists longer than ``list_size`` are not compared pair by pair.  Their
fingerprints meet at midpoints instead: two of them differ in d bits or fewer
exactly if some word is d/2 bits or fewer from both (for odd d, after one bit
is left out).  No more fingerprints can meet at a midpoint than lie around it,
so its rows are linked one to the next.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.components import components
from tillroll.llm.text import map_texts, merged, written

CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bits set in more than half of the XXH64 values of the word shingles."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    k = min(shingle, len(words))
    stop = (start + size)[k - 1:].tolist()
    start = start.tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, len(stop), CHUNK):
        cuts = [joined[a:b] for a, b in zip(start[at:at + CHUNK], stop[at:at + CHUNK])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(seed)), np.uint64, len(cuts))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (votes * 2 > len(stop)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, carry: list[Column], text: Column, shingle: int = 4,
                 seed: int = 42) -> DataFrame:
    """``carry`` columns and ``fp``, the 64 bits as a long, of every whole text."""
    def make():
        return lambda texts: [pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64())]

    return map_texts(docs, carry, F.coalesce(text, F.lit("")), make, "fp long")


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def posting_keys(fp: Column, matches: int) -> Column:
    """An array with a key for each choice of ``matches`` byte positions."""
    masks = [sum(0xFF << (8 * p) for p in places) for places in combinations(range(8), matches)]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_as_long(m)).cast("long")))
                     for i, m in enumerate(masks)])


def linked_parts(fps: np.ndarray, matches: int, max_bits: int) -> list[tuple[int, int]]:
    """Links from the first member of each connected part of a posting list."""
    n = len(fps)
    raw, bits = fps.view(np.uint8).reshape(n, 8), fps.view(np.uint64)
    todo, out = np.ones(n, bool), []
    while todo.any():
        root = int(todo.argmax())
        todo[root] = False
        front = [root]
        while front:
            k = front.pop()
            at = np.flatnonzero(todo)
            shared = (raw[at] == raw[k]).sum(1)  # tally of shared positional bytes
            at = at[shared >= matches]
            near = at[np.bitwise_count(bits[at] ^ bits[k]) <= max_bits]
            todo[near] = False
            out.extend((int(fps[root]), int(fps[j])) for j in near.tolist())
            front.extend(near.tolist())
    return out


def _links_in_lists(lists: DataFrame, matches: int, max_bits: int) -> DataFrame:
    def run(batches):
        for b in batches:
            pairs = [p for x in b.column(0) for p in linked_parts(
                np.sort(x.values.to_numpy()), matches, max_bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def _links_at_midpoints(fps: DataFrame, max_bits: int) -> DataFrame:
    one = [1 << i for i in range(64)]
    flips = np.array([sum(c) for r in range(max_bits // 2 + 1) for c in combinations(one, r)],
                     dtype=np.uint64)
    left_out = [0] if max_bits % 2 == 0 else one  # 0: no bit is left out

    def run(batches):
        for b in batches:
            x = b.column(0).to_numpy()
            for part in np.array_split(x, len(x) // 256 + 1):
                for bit in left_out:
                    keep = np.uint64(~bit & (1 << 64) - 1)
                    mid = np.unique((part.view(np.uint64)[:, None] ^ flips) & keep, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mid.ravel().view(np.int64)), pa.array(np.full(mid.size, bit.bit_length())),
                         pa.array(np.repeat(part, mid.shape[1]))], names=["mid", "out", "fp"])

    around = Window.partitionBy("out", "mid").orderBy("fp")
    return (fps.mapInArrow(run, "mid long, out long, fp long")
            .select(F.lag("fp").over(around).alias("a"), F.col("fp").alias("b"))
            .where("a <> b"))


def links(fps: DataFrame, max_bits: int = 4, list_size: int = 4096) -> DataFrame:
    """(a, b): links of ``max_bits`` differing bits or fewer between distinct
    fingerprints (column ``fp``, each once) that join every linked pair."""
    if not 0 <= max_bits <= 7:
        raise ValueError("with more than 7 differing bits no positional byte need be shared")
    matches = 8 - max_bits
    keys = fps.select("fp", F.explode(posting_keys(F.col("fp"), matches)).alias("key"))
    size = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(merged(size), "key").select("key", "n", "fp"), "postings")
    lists = (members.where(F.col("n") <= list_size).groupBy("key")
             .agg(F.collect_list("fp").alias("fps")).select("fps"))
    found = _links_in_lists(lists, matches, max_bits)
    long = members.where(F.col("n") > list_size).select("fp").distinct()
    if not long.isEmpty():
        found = found.unionAll(_links_at_midpoints(long, max_bits))
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: Column, text: Column, shingle: int = 4,
                    max_bits: int = 4, seed: int = 42, carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fp`` (long),
    ``component_id``, the least id that is reachable over links of ``max_bits``
    differing bits or fewer, and ``component``, the least fingerprint among them,
    then the ``carry`` columns.

    A null or empty text has fingerprint 0 and is linked like any other; equal
    texts link whatever their ids; a null id is never the least unless its
    component holds no other (then ``component_id`` is null).
    """
    table = written(fingerprints(docs, [doc_id.alias("doc_id"), *carry], text, shingle, seed), "fingerprints")
    distinct = written(table.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    part = components(links(distinct.select("fp"), max_bits))
    labelled = (distinct.join(merged(part.select(F.col("a").alias("fp"), F.col("b").alias("root"))), "fp", "left")
                .withColumn("root", F.coalesce("root", "fp")))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(merged(least), "root").select("fp", "component_id", F.col("root").alias("component"))
    extra = [c for c in table.columns if c not in ("doc_id", "fp")]
    return table.join(merged(named), "fp").select("doc_id", "fp", "component_id", "component", *extra)


def one_of_each(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4, max_bits: int = 4,
                seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component of near-duplicates:
    the one with the least id.  Of several rows with that id the one with the least
    hash of its text stays, of repeated ones the one with the least hash of its
    columns; likewise in a component without any id."""
    of_text = F.xxhash64(F.col(text_col))
    near = near_duplicates(docs, F.col(id_col), F.col(text_col), shingle, max_bits, seed, (of_text.alias("text_hash"),))
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "rows")
    least = written(near.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
                    .groupBy("component").agg(F.min(first).alias("least")).select("least.*"), "least")
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), of_text.alias("_text"))
    stay = keyed.join(merged(least), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text") == F.col("text_hash")),
                      "left_semi")
    if not least.where("rows > 1").isEmpty():
        stay = stay.groupBy("_id", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return stay.select("_row.*")


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
