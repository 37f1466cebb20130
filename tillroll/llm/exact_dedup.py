"""Exact dedup by composable polynomial fingerprints.

A fingerprint is the byte length of a text and, for two primes, the value of the
polynomial whose coefficients are its bytes.  Fingerprints of chunks compose: the
value of a whole is the sum of its chunks' values, each times the base to the number
of bytes that follow it.  So the chunks of a huge text are hashed by different tasks
and meet in a plain sum.

Rows of one fingerprint are only candidates.  Each is compared, chunk by chunk, with
the chunks of one head a fingerprint; those that differ are compared among themselves
in a next round.  A bitmap of the fingerprints that occur twice, of a fixed size,
keeps the other texts out of the shuffle; what it lets pass too much falls away in
the count.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.text import written

#: Bytes of a chunk: sums of bytes times values below 2^31 stay below 2^64 up to 2^24.
CHUNK_BYTES = 1 << 16
#: The two largest primes below 2^31, and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (1540483477, 1181783497)
#: Bits of the bitmap of repeated fingerprints: 4 MB, whatever the input.
BITMAP_BITS = 25
PRINT = ["n_bytes", "f0", "f1"]
_LEAST = -(1 << 63)


@lru_cache(maxsize=8)
def _falling(base: int, modulus: int, n: int) -> np.ndarray:
    """base^(n-1), ..., base, 1 by the modulus."""
    out, x = np.empty(n, np.uint64), 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


def chunk_value(chunk: bytes, base: int, modulus: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    """The polynomial of the bytes of one chunk."""
    b = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    return int(np.dot(b, _falling(base, modulus, chunk_bytes)[chunk_bytes - len(b):])) % modulus


def shifted(value: int, after: int, base: int, modulus: int) -> int:
    """What a chunk adds to the whole when ``after`` bytes follow it."""
    return value * pow(base, after, modulus) % modulus if after else value


def _with_values(chunks: DataFrame, chunk_bytes: int, moduli: tuple, keep_chunk: bool) -> DataFrame:
    """``f0`` and ``f1``, what each chunk adds to its whole; columns ``after`` and
    ``chunk`` come last, the latter stays on request."""
    kept = chunks.schema.fields if keep_chunk else chunks.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField("f0", T.LongType()), T.StructField("f1", T.LongType())])
    names = schema.names

    def run(batches):
        for b in batches:
            k = b.num_columns - 1
            raw = [x.as_buffer() for x in b.column(k)]
            after = b.column(k - 1).to_pylist()
            each = [pa.array([shifted(chunk_value(c, r, m, chunk_bytes), a, r, m)
                              for c, a in zip(raw, after, strict=True)], pa.int64())
                    for r, m in zip(BASES, moduli, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], *each], names=names)

    return chunks.mapInArrow(run, schema)


def _single(rows: DataFrame, chunk_bytes: int, moduli: tuple, keep_chunk: bool) -> DataFrame:
    """Fingerprints of the texts of one chunk, where they are read."""
    one = rows.where(F.length("bytes") <= chunk_bytes).select(
        "row", "id", F.length("bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("after"),
        F.col("bytes").alias("chunk"))
    return _with_values(one, chunk_bytes, moduli, keep_chunk)


def _chunks(huge: DataFrame, chunk_bytes: int) -> DataFrame:
    """(key, part, after, chunk): a row for each chunk of each text."""
    n = F.length("bytes")
    parts = huge.select("key", "bytes", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk_bytes).cast("int")))
                        .alias("part"))
    return parts.select(
        "key", "part", F.greatest(n.cast("long") - (F.col("part").cast("long") + 1) * chunk_bytes, F.lit(0))
        .alias("after"),
        F.expr(f"substring(bytes, part * {chunk_bytes} + 1, {chunk_bytes})").alias("chunk"))


def _composed(huge: DataFrame, chunk_bytes: int, moduli: tuple) -> DataFrame:
    """(key, f0, f1) of texts of many chunks, hashed by many tasks."""
    dealt = _chunks(huge, chunk_bytes).repartition("key", "part")
    sums = [F.pmod(F.sum(f"f{i}"), F.lit(m)).alias(f"f{i}") for i, m in enumerate(moduli)]
    return _with_values(dealt, chunk_bytes, moduli, False).groupBy("key").agg(*sums)


def _bitmap(prints: DataFrame) -> DataFrame:
    """(bucket, bitmap): at most 2^BITMAP_BITS bits over all rows together."""
    bit = _bit()
    return prints.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))


def _bit() -> Column:
    return F.xxhash64(*PRINT).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def _marked(prints: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows whose fingerprint has its bit set."""
    at = F.bitmap_bit_position(_bit())
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, _at) & 1")
    near = prints.withColumn("_bucket", F.bitmap_bucket_number(_bit())).join(
        F.broadcast(bitmap), F.col("_bucket") == F.col("bucket"))
    return (near.withColumns({"_byte": byte, "_at": (at % 8).cast("int")}).where(is_set == 1)
            .drop("_bucket", "bucket", "bitmap", "_byte", "_at"))


def _verified(members: DataFrame) -> DataFrame:
    """(key, keep_id, head): ``members`` are chunk rows; rows of one fingerprint are
    compared with the chunks of their head, the row with the largest id, and those that
    differ among themselves in a next round."""
    found, rest, first = [], members, True
    while True:
        heads = (rest.where("part = 0").groupBy(PRINT)
                 .agg(F.max_by("key", F.coalesce("id", F.lit(_LEAST))).alias("head"), F.max("id").alias("keep_id"),
                      F.count("*").alias("rows")))
        # A row alone in its fingerprint is what the bitmap let pass.
        heads = written(heads.where("rows > 1") if first else heads, "dedup-heads")
        base = rest.select("key", "part", F.col("chunk").alias("base")).join(
            heads.withColumnRenamed("head", "key"), "key").withColumnRenamed("key", "head").drop("rows")
        same = F.col("chunk") == F.col("base")
        compared = written(
            rest.select("key", "part", "chunk", *PRINT).join(base, [*PRINT, "part"])
            .groupBy("key", "keep_id", "head").agg(F.bool_and(same).alias("same")), "dedup-compared")
        found.append(compared.where("same").drop("same"))
        if compared.where("not same").isEmpty():
            return reduce(DataFrame.unionByName, found)
        rest, first = written(rest.join(compared.where("not same").select("key"), "key", "left_semi"),
                              "dedup-rest"), False


def exact_duplicates(docs: DataFrame, carry: list[Column], doc_id: Column, text: Column,
                     chunk_bytes: int = CHUNK_BYTES, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``carry`` columns, ``keep_id`` (the id of the row that stays), ``group_size`` and
    ``kept``: a row for every row.

    Rows are one group if their texts are the same bytes; the row with the largest
    ``doc_id`` stays.  A null text counts as empty.  A null id is less than any other;
    of repeated rows with one id a single one stays.  Texts of any length are hashed and
    compared in chunks of ``chunk_bytes``.  An empty table gives an empty one; extra
    columns, whatever their names, play no part.  ``moduli`` are primes below 2^31:
    smaller ones make more rounds of comparison, never another result.
    """
    rows = docs.select(F.struct(*carry).alias("row"), doc_id.cast("long").alias("id"),
                       F.coalesce(text.cast("binary"), F.lit(b"")).alias("bytes"))
    huge = written(rows.where(F.length("bytes") > chunk_bytes)
                   .withColumn("key", F.monotonically_increasing_id() * 2 + 1), "dedup-huge")
    huge_prints = written(
        huge.select("key", "id", "row", F.length("bytes").cast("long").alias("n_bytes"))
        .join(_composed(huge, chunk_bytes, moduli), "key"), "dedup-huge-prints")

    prints = _single(rows, chunk_bytes, moduli, False).drop("after").unionByName(huge_prints.drop("key"))
    groups = written(prints.groupBy(PRINT).agg(F.count("*").alias("group_size"), F.first("id").alias("keep_id"),
                                               F.first("row").alias("row")), "dedup-groups")
    alone = groups.where("group_size = 1").select("row", "keep_id", "group_size", F.lit(True).alias("kept"))

    repeated = written(_bitmap(groups.where("group_size > 1")), "dedup-bitmap")
    small = (_marked(_single(rows, chunk_bytes, moduli, True).drop("after"), repeated)
             .withColumn("key", F.monotonically_increasing_id() * 2).withColumn("part", F.lit(0)))
    large = _marked(huge_prints, repeated).join(_chunks(huge, chunk_bytes).drop("after"), "key")
    members = written(small.unionByName(large), "dedup-members")

    verified = written(_verified(members.drop("row")), "dedup-verified")
    sizes = verified.groupBy("head").agg(F.count("*").alias("group_size"))
    groups_of_many = (members.where("part = 0").select("key", "row").join(verified, "key").join(sizes, "head")
                      .select("row", "keep_id", "group_size", (F.col("key") == F.col("head")).alias("kept")))
    return alone.unionByName(groups_of_many).select("row.*", "keep_id", "group_size", "kept")
